"""Operators on spans: overlap removal, merging by text, containment, coverage, rendering order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealgrove.functions.scan import MENTIONS, folded, let


def trimmed(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def key_of(x: Column) -> Column:
    """What makes two mentions the same entity: their text, trimmed and in lower case."""
    return F.lower(trimmed(x))


#: Spans of a text that have a bit each.
FEW = 62


def _fold(spans: Column, wins, kind: str = MENTIONS) -> Column:
    """Spans in order of their starts, without overlaps: of two that overlap, `wins(next, kept)` says whether the next replaces the kept one."""
    none = F.array().cast(kind)

    def step(keep: Column, x: Column) -> tuple[Column, Column]:
        apart = keep.isNull() | (x["s"] >= keep["e"])
        return F.when(apart | wins(x, keep), x).otherwise(keep), F.when(apart & keep.isNotNull(), F.array(keep)).otherwise(none)

    last = lambda r: F.when(r["state"].isNull(), r["out"]).otherwise(F.concat(r["out"], F.array(r["state"])))
    many = lambda xs: let(folded(xs, kind, F.lit(None).cast(kind[len("array<") : -1]), step), last)
    return let(spans, lambda xs: F.when(F.size(xs) > FEW, many(xs)).otherwise(_few(xs, wins)))


def _few(spans: Column, wins) -> Column:
    """`_fold` of up to FEW spans, of which none is null: the kept ones are bits of a number, so that no array is copied for each."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def step(acc: Column, i: Column) -> Column:
        def next_(x: Column, keep: Column) -> Column:
            apart = x["s"] >= keep["e"]
            return F.when(apart, F.struct(i.alias("k"), acc["bits"].bitwiseOR(bit(i)).alias("bits"))).when(wins(x, keep), F.struct(i.alias("k"), acc["bits"].bitwiseXOR(bit(acc["k"]).bitwiseOR(bit(i))).alias("bits"))).otherwise(acc)

        return next_(F.get(spans, i), F.get(spans, acc["k"]))

    start = F.struct(F.lit(0).alias("k"), F.lit(1).cast("long").alias("bits"))
    bits = F.aggregate(F.sequence(F.lit(1), F.size(spans) - 1), start, step)["bits"]
    kept = let(bits, lambda b: F.filter(spans, lambda _, i: b.bitwiseAND(bit(i)) != 0))
    return F.when(F.size(spans) < 2, spans).otherwise(kept)


def in_order(spans: Column) -> Column:
    """By start, recognizer, pattern and end."""
    keyed = F.transform(spans, lambda x: F.struct(x["s"], x["rec_ord"], x["pat_ord"], x["e"], x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def without_overlaps(spans: Column) -> Column:
    """Greedy overlap removal: higher confidence wins, then longer text; what was kept before that stays."""
    return _fold(in_order(spans), lambda x, k: (x["confidence"] > k["confidence"]) | ((x["confidence"] == k["confidence"]) & (F.length(x["text"]) > F.length(k["text"]))))


def for_rendering(spans: Column, kind: str) -> Column:
    """Of overlapping spans the longer one, of equal ones the earlier."""
    return _fold(F.array_sort(spans), lambda x, k: (x["e"] - x["s"]) > (k["e"] - k["s"]), kind)


def without_chunk_overlaps(spans: Column) -> Column:
    """Spans by start, longer first; one that overlaps the last kept end by more than half of itself is skipped."""
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-(x["e"] - x["s"])).alias("l"), x["e"].alias("e")))
    kind = "array<struct<s:int,l:int,e:int>>"

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        skip = (end - x["s"]) > F.floor((x["e"] - x["s"]) / 2)
        return F.when(skip, end).otherwise(F.greatest(end, x["e"])), F.when(skip, F.array().cast(kind)).otherwise(F.array(x))

    return folded(F.array_sort(keyed), kind, F.lit(0), step)["out"]


def merged_by_text(mentions: DataFrame, *doc: str) -> DataFrame:
    """An entity for each text of a document: first original, positions, best confidence; a person's type wins over a location. `doc`: the columns that name a document, `row` and doc_id by default.

    Mentions are dealt by document before they are aggregated: few of a part of them merge, and what is counted by document afterwards needs no further deal.
    """
    doc = doc or ("row", "doc_id")
    m = mentions.repartition(*doc).withColumn("key", key_of(F.col("text"))).filter(F.length("key") > 1)
    order = F.struct("s", "rec_ord", "pat_ord", "e")
    person = F.col("type").startswith("person")
    return m.groupBy(F.xxhash64(*doc, "key").alias("_by"), *doc, "key").agg(  # sorted by a number, not by a structure
        F.min_by("text", order).alias("original"), F.min_by("type", order).alias("_type"), F.min_by("type", F.when(person, order)).alias("_person"),
        F.max("confidence").alias("confidence"), F.min("s").alias("first_start"), F.countDistinct("s", "e").alias("n_positions"),
        F.array_sort(F.collect_set(F.struct("s", "e"))).alias("positions"),
    ).withColumn("type", F.when((F.col("_type") == "location") & F.col("_person").isNotNull(), F.col("_person")).otherwise(F.col("_type"))).drop("_by", "_type", "_person")


def valid_positions(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans within their text: 0 <= s < e <= length."""
    return spans.join(texts.select("doc_id", F.length("text").alias("_n")).hint("merge"), "doc_id").filter("s >= 0 and s < e and e <= _n").drop("_n")


def position_issues(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """What is wrong with spans: negative, reversed, beyond the end, or another text than the entity's."""
    joined = spans.join(texts.select("doc_id", F.col("text").alias("_text")).hint("merge"), "doc_id")  # texts are never broadcast
    found = F.expr("substring(_text, s + 1, e - s)")
    kind = F.when(F.col("s") < 0, "negative").when(F.col("e") <= F.col("s"), "reversed").when(F.col("e") > F.length("_text"), "beyond_end").when(found != F.col("text"), "other_text")
    return joined.withColumn("issue", kind).filter(F.col("issue").isNotNull()).drop("_text")
