"""Odd inputs that every operator must take."""

LONG = "Onther stion andre. " * 9000
CLASHES = "shard slot grown_shard _h _row _key _bucket score lang_pred ids decoded _text n_lines n_dropped target shards sha _sha component_id id a b size copy".split()


def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls in every column, empty and long texts, ties and repeated rows."""
    rows = [
        (1, "The and of onthe. Is there an other that is so?\nWell then.", "en", "s1", 60),
        (2, "The and of onthe. Is there an other that is so?\nWell then.", "en", "s1", 60),
        (2, "The and of onthe. Is there an other that is so?\nWell then.", "en", "s1", 60),
        (3, "", "fr", "s1", 0), (4, None, None, "s2", None), (5, None, "de", None, 3), (None, "Der die das und ist nicht ein.", "de", None, 30),
        (None, None, None, None, None), (6, LONG, "en", "s2", len(LONG)), (7, LONG, None, "s2", len(LONG)), (8, " \t\n\r\x0b\x0c ", "es", "s3", 7), (9, "1234 5678 ...", "es", "", 13),
        (10, "😀 é́ ß <|endoftext|> \u0000 x", "es", "s3", 20), (-5, "Der die das und ist nicht ein.", "de", "s1", 30), (11, "x", "en", "s1", 1),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, clashes=False, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clashes else df


def write_tables(df, path, labels=None):
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    if labels is not None:
        labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)
