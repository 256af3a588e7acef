"""Queries of the recognizers, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealgrove.functions import words as w
from sealgrove.operators.dictionary import listed, with_hits
from sealgrove.operators.recognizers import BY_NAME, RULES, Rule, inclusion_rule, mentions
from sealgrove.plans.notes import SQL as NOTES
from sealgrove.plans.notes import notes
from sealgrove.sources.tables import read_table, spread

INCLUDED = [("came, too", "person_other"), ("high street", "location"), ("Versteeg", "person_client"), ("STREET", "organization"), ("ere", "identifier"), ("Weighs", "date")]
EXCLUDED = ("weighs", "versteegh")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_scan(table: str, rule: Rule, where: str = "true", keys: str = "doc_id") -> str:
    """A rule's mentions in DuckDB: the pieces between matches give the offsets."""
    p = _quote(rule.pattern)
    drop = f" and lower(text) not in ({', '.join(map(_quote, rule.drop))})" if rule.drop else ""
    return f"""
    select {keys}, cast(e - length(text) as int) as s, cast(e as int) as e, text, '{rule.type}' as type, cast({rule.confidence} as double) as confidence,
      {rule.rec_ord} as rec_ord, {rule.pat_ord} as pat_ord
    from (select {keys}, g as text, sum(length(gap) + length(m)) over (partition by {keys} order by i) as e
      from (select {keys}, unnest(regexp_extract_all(text, {p})) as m, unnest(regexp_extract_all(text, {p}, {rule.group})) as g,
          unnest(string_split_regex(text, {p})[1:len(regexp_extract_all(text, {p}))]) as gap, generate_subscripts(regexp_extract_all(text, {p}), 1) as i
        from {table} where regexp_matches(text, {p})))
    where {where}{drop}"""


def _query(names: tuple[str, ...], source):
    rules = tuple(BY_NAME[n] for n in names)
    return lambda spark, sf_dir: mentions(source(spark, sf_dir), rules)


def _sql(names: tuple[str, ...], table: str, where: str = "true") -> str:
    return f"with notes as ({NOTES})" * (table == "notes") + " union all ".join(sql_scan(table, BY_NAME[n], where) for n in names)


ON_NOTES = {
    "det_phone": ("phone_mobile", "phone_landline", "phone_international", "phone_free"), "det_medical_id": ("id_nhi", "id_acc", "id_record", "id_dashed"),
    "det_dates": ("date_slash", "date_dash", "date_iso", "date_month_day", "date_day_month", "date_day_mon"),
    "det_address": ("place_street", "place_suburb", "place_city", "place_hospital", "place_board"), "det_known_names": ("known_name",),
    "det_titles": ("title_name",), "det_relationships": ("relation_name", "relation_word"),
}
ON_DOCUMENTS = {"det_email": ("email",), "det_numbers_p1": ("numbers_joined",), "det_numbers_p2": ("numbers_spaced",), "det_numbers_p3": ("numbers_short",), "det_numbers_p4": ("numbers_long",)}

QUERIES = {k: _query(v, notes) for k, v in ON_NOTES.items()} | {k: _query(v, _documents) for k, v in ON_DOCUMENTS.items()}
ORACLES = {k: _sql(v, "notes") for k, v in ON_NOTES.items()} | {k: _sql(v, "documents") for k, v in ON_DOCUMENTS.items()}

#: All rules but the one that needs lookahead, which RE2 lacks.
SQL_RULES = tuple(r for r in RULES if r.name != "id_alnum")
ALL_SQL = " union all ".join(sql_scan("notes", r) for r in SQL_RULES)


def all_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(notes(spark, sf_dir), SQL_RULES)


def det_alnum_catchall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(_documents(spark, sf_dir), (BY_NAME["id_alnum"],)).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


def det_double_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(notes(spark, sf_dir), (BY_NAME["double_capital"],)).select("doc_id", "s", "e", "text")


def det_model_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(notes(spark, sf_dir), (BY_NAME["model_identifier"],)).select("doc_id", "s", "e", "text")


def det_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's words with their types, but for the one that is excluded."""
    return mentions(notes(spark, sf_dir), (inclusion_rule(INCLUDED),), exclude=EXCLUDED).select("doc_id", "s", "e", "text", "type", "confidence")


def det_user_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and titled names with some excluded, beside the user's words."""
    rules = (BY_NAME["known_name"], BY_NAME["title_name"], BY_NAME["relation_name"], inclusion_rule(INCLUDED))
    return mentions(notes(spark, sf_dir), rules, exclude=("SEAN", "aroha", "Lintern")).select("doc_id", "s", "e", "text", "type", "rec_ord")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, type) of the words of five to eight letters of every other document; none that can overlap itself."""
    words = read_table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    apart = " and ".join(f"left(word, {b}) <> right(word, {b})" for b in range(1, 5))
    return words.filter(f"length(word) between 5 and 8 and {apart}").distinct().withColumn("type", F.expr("concat('t', length(word) % 3)"))


def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all those words in all documents, inside longer words too."""
    found = with_hits(_documents(spark, sf_dir), listed(_listed(spark, sf_dir)))
    hit = found.select("doc_id", F.explode("hits").alias("h"))
    return hit.groupBy("doc_id", F.col("h.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h.s").cast("long")).alias("starts"))


def det_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by type, over all rules in one pass."""
    return all_mentions(spark, sf_dir).groupBy("type", "rec_ord", "pat_ord").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("chars"))


_RUNS = "select doc_id, trim(unnest(regexp_extract_all(text, '[A-Za-z0-9-]+')), '-') as text from documents"
_DOUBLE = "substr(text, 1, 2) not in (" + ", ".join(map(_quote, w.CAPITAL_PREFIXES)) + ")"
_MODEL = "regexp_matches(text, '[A-Za-z]') and regexp_matches(text, '[0-9]') and lower(text) not in (" + ", ".join(map(_quote, w.ABBREVIATIONS)) + ")"
_INCLUDED = [Rule("inclusion", 8, 0, f"(?i){word}", type, 1.0) for word, type in INCLUDED]
QUERIES |= {"det_alnum_catchall": det_alnum_catchall, "det_double_capitals": det_double_capitals, "det_model_identifiers": det_model_identifiers, "det_inclusions": det_inclusions, "det_user_words": det_user_words, "dictionary_scan": dictionary_scan, "det_all": det_all}
ORACLES |= {
    "det_alnum_catchall": f"select doc_id, text, count(*) as n from ({_RUNS}) where length(text) >= 4 and regexp_matches(text, '[A-Za-z]') and regexp_matches(text, '[0-9]') group by all",
    "det_double_capitals": f"with notes as ({NOTES}) select doc_id, s, e, text from ({sql_scan('notes', BY_NAME['double_capital'], _DOUBLE)})",
    "det_model_identifiers": f"with notes as ({NOTES}) select doc_id, s, e, text from ({sql_scan('notes', BY_NAME['model_identifier'], _MODEL)})",
    "det_inclusions": f"with notes as ({NOTES}) select doc_id, s, e, text, type, confidence from ({' union all '.join(sql_scan('notes', r) for r in _INCLUDED if r.type != 'date')})",
    "det_user_words": f"""with notes as ({NOTES}) select doc_id, s, e, text, type, rec_ord from (
      {' union all '.join(sql_scan('notes', BY_NAME[n], "lower(text) not in ('sean', 'aroha', 'lintern')") for n in ('known_name', 'title_name'))}
      union all {sql_scan('notes', BY_NAME['relation_name'])} union all {' union all '.join(sql_scan('notes', r) for r in _INCLUDED)})""",
    "dictionary_scan": """with words as (select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents where doc_id % 2 = 0)
        where length(word) between 5 and 8 and left(word, 1) <> right(word, 1) and left(word, 2) <> right(word, 2) and left(word, 3) <> right(word, 3) and left(word, 4) <> right(word, 4)),
      places as (select doc_id, lower(text) as x, unnest(range(1, length(text) + 1)) as i from documents)
      select doc_id, 't' || length(word) % 3 as type, count(*) as n, sum(i - 1)::bigint as starts
      from (select doc_id, i, unnest([substr(x, i, 5), substr(x, i, 6), substr(x, i, 7), substr(x, i, 8)]) as word, unnest([5, 6, 7, 8]) as size from places) join words using (word)
      where length(word) = size group by all""",
    "det_all": f"with notes as ({NOTES}) select type, rec_ord, pat_ord, count(*) as n, sum(e - s)::bigint as chars from ({ALL_SQL}) group by all",
}
