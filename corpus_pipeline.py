"""A training-data pipeline over `documents`: five stages, each an operator of sealgrove.llm applied to all that its predecessor kept.

Every stage but the last returns the columns of `documents`. Edge cases: an empty table runs through; null and empty texts have no
letter and go in the first stage; near dedup looks at texts alone, so rows of equal doc_id are
near copies only where their texts are, and documents without a doc_id stay unless another row is their near copy; columns of other
names are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealgrove.llm import bpe, langid, lines, mixing, simhash
from sealgrove.llm.texts import held_out, unused
from sealgrove.sources.tables import read_table, written

#: A document is rejected when so few of its n-grams belong to any language that none can be told.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from those of a known language that aren't held out."""
    model = langid.learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = langid.predict(docs, model, lang_pred=lang, score=score)
    return found.filter((F.col(lang) != langid.UND) & (F.col(score) >= MIN_SCORE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    out = lines.drop_boilerplate(docs, "source", "text")
    n_chars = F.coalesce(F.length("text").cast("long"), F.col("n_chars")).alias("n_chars")
    return out.select(*(n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity of 0.8 or more): the one of smallest doc_id, which goes before none."""
    row, own = unused(docs, "row"), [F.xxhash64(*(F.lit(k), *(F.col(f"`{c}`") for c in docs.columns))) for k in (0, 1)]
    rows = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *(x.alias(f"own{k}") for k, x in enumerate(own))))  # a row's order and its name
    groups = simhash.near_duplicates(rows.select("doc_id", "text", row), extra=(row,))
    groups = written(groups.select("group_no", row), "members")
    leaders = groups.groupBy("group_no").agg(F.min(row).alias(row))
    if groups.groupBy(row).count().filter("count > 1").isEmpty():
        gone = written(groups.join(leaders, row, "left_anti").select(row), "copies")
        kept = simhash.reached(rows, gone, row, "left_anti")
    else:  # repeated rows have one name
        kept = rows.join(leaders, row, "left_semi").dropDuplicates([row])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each copy taken, dealt to shards and shuffled there."""
    return mixing.mix_sources(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text")).select("row.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids (little-endian unsigned 32-bit integers), whether they decode to the text, and digests."""
    out = bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "n_chars", "text"))
    return out.select(
        "doc_id", "source", "lang", "n_chars", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"),
    )


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("bpe_encoding", bpe_encoding)]
#: SQL can't express language ID, SimHash links or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
