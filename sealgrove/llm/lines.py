"""Line dedup by site-relative frequency.

Lines are compared without white space at their ends. For each host, the pages that contain a line are divided by the
host's pages; a line on at least `min_pages` pages with a share above `max_ratio` is boilerplate there and goes from every
page of the host. Blank lines always stay.

Edge cases: null text stays null and has no lines, but its page counts for the host; null is a host like any other; a line
that a page repeats counts once for it; a repeated row is a page of its own; a page whose lines all go keeps an empty text;
existing columns named n_lines or n_dropped are replaced where counts are asked for.

Lines are keyed by 64-bit hashes within their host. A host has at most (mean distinct lines of a page / max_ratio) boilerplate
lines, so the set attached to its pages is bounded however large the host is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealgrove.llm.texts import carried, others, unpacked
from sealgrove.sources.tables import read_table, written

MIN_PAGES = 5
MAX_RATIO = 0.1
ENDS = " \t\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(ENDS))


def boilerplate(df: DataFrame, host: Column, text: str = "text", min_pages: int = MIN_PAGES, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The boilerplate of each host: host and the set of its lines' hashes."""
    lines = F.filter(F.transform(F.split(text, "\n"), _bare), lambda x: x != "")
    pages = df.select(host.alias("_host"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("_lines"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    seen = pages.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    often = seen.filter(F.col("_n") >= min_pages).alias("a").join(totals.alias("b"), F.expr("a._host <=> b._host"))
    often = often.filter(F.col("_n") > F.col("_pages") * F.lit(max_ratio))
    return often.groupBy("a._host").agg(F.collect_set("_line").alias("_bad"))


def drop_boilerplate(
    df: DataFrame, host: Column | str = "source", text: str = "text", min_pages: int = MIN_PAGES, max_ratio: float = MAX_RATIO, counts: bool = False
) -> DataFrame:
    """`df` without its hosts' boilerplate lines; with `counts`, columns n_lines and n_dropped follow.

    `host` is a column or an expression, such as parse_url(url, 'HOST'). The boilerplate table is written first, so that
    Spark knows its size: a small one is broadcast under spark.sql.autoBroadcastJoinThreshold, a larger one is joined by
    host, where adaptive execution splits hot hosts.
    """
    host = F.col(host) if isinstance(host, str) else host
    bad = written(boilerplate(df, host, text, min_pages, max_ratio), "boilerplate")
    joined = carried(df, _key=host, _text=F.col(text)).join(bad, F.col("_key").eqNullSafe(F.col("_host")), "left")
    lines = F.split("_text", "\n")
    is_bad = lambda x: (_bare(x) != "") & F.array_contains(F.col("_bad"), F.xxhash64(_bare(x)))
    kept = F.when(F.col("_bad").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(lines, lambda x: ~is_bad(x)), "\n"))
    new = []
    if counts:
        none = F.col("_text").isNull()
        new.append(F.when(none, 0).otherwise(F.size(lines)).cast("long").alias("n_lines"))
        new.append(F.when(none | F.col("_bad").isNull(), 0).otherwise(F.size(F.filter(lines, is_bad))).cast("long").alias("n_dropped"))
    columns = others(df, *(["n_lines", "n_dropped"] if counts else []))
    return joined.select(*(kept.alias(c) if c == text else unpacked(joined, [c])[0] for c in columns), *new)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, their source as host: lines, dropped lines and what is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_boilerplate(docs, "source", "text", counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
with lines as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
bare as (select *, trim(line, ' ' || chr(9) || chr(13)) as b from lines),
pages as (select source, count(*) as pages from documents group by source),
seen as (select source, b, count(distinct doc_id) as n from bare where b <> '' group by source, b),
bad as (select s.source, s.b from seen s join pages p on s.source is not distinct from p.source where n >= {MIN_PAGES} and n > pages * cast({MAX_RATIO} as double)),
kept as (
  select l.doc_id, count(*) as n_lines, count(*) filter (where x.b is not null) as n_dropped,
    coalesce(string_agg(l.line, chr(10) order by l.i) filter (where x.b is null), '') as kept
  from bare l left join bad x on l.source is not distinct from x.source and l.b = x.b group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped,
  length(kept)::bigint as kept_chars, sha256(kept) as kept_sha256
from documents d left join kept using (doc_id)
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": SQL}
