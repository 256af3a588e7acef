"""Names of one person, in groups: who may be merged into whom.

Names of a session meet by what they share, in joins: full names by first and last name, single names by their word, beginnings by their prefixes. No pair is formed of names that share nothing.
The groups are taken greedily: full names in order, each with the names that match it and haven't been taken yet. This depends on the order, so pairs are sorted by Spark and one pass over them
remembers which names of the session at hand are taken.

* high: a name of two words, or with a title, and a full name with the same first and last name; a single name and a full name that holds it
* low: the same where it is open who is meant: the single name is the first name of several full names, or a titled full name has the last name of several; one group for each full name
* low: single names that are alike or begin alike, with the longer one as primary

Order: names by lower case, then as they are. Names of one code are merged already and make no pair. Names that consist of a title alone, or of nothing, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.functions.names import NAME_TITLES
from sealgrove.operators.joins import joined

PAIRS = "session_id string, phase int, primary_name string, match_name string, own string, other string"
GROUPS = "session_id string, primary_name string, match_name string, confidence string"


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.btrim(name)), r"\s+"), lambda x: x != "")


def taken_apart(names: DataFrame) -> DataFrame:
    """(session_id, name, code, titled, parts): names in lower case without their title."""
    own = names.withColumn("_w", _words(F.col("name")))
    own = own.withColumn("titled", F.coalesce(F.get("_w", F.lit(0)).isin(*NAME_TITLES), F.lit(False)))
    return own.withColumn("parts", F.when(F.col("titled"), F.slice("_w", 2, 1000)).otherwise(F.col("_w"))).filter(F.size("parts") > 0).drop("_w")


def candidate_pairs(names: DataFrame) -> DataFrame:
    """(session_id, phase, primary_name, match_name): 0 sure, 1 open, 2 single names; phase 1 is in order of the match, the others of the primary."""
    if "code" not in names.columns:
        names = names.withColumn("code", F.lit(None).cast("string"))
    own = taken_apart(names.select("session_id", "name", "code").distinct())
    own = own.withColumns({"first": F.get("parts", F.lit(0)), "last": F.when(F.size("parts") > 1, F.element_at("parts", -1))})
    full = own.filter("last is not null")
    single = own.filter("last is null").select("session_id", F.col("name").alias("match_name"), F.col("code").alias("_code"), F.col("first").alias("word"))
    shared = {c: F.count(F.lit(1)).over(Window.partitionBy("session_id", c)) > 1 for c in ("first", "last")}
    full = full.withColumns({"shared_first": shared["first"], "shared_last": shared["last"]})
    apart = F.coalesce(F.col("code") != F.col("_code"), F.lit(True))

    # Full names: the first and last name are the same. A title and the last name of several leave it open.
    other = full.filter("size(parts) = 2 or titled").select("session_id", "first", "last", F.col("name").alias("match_name"), F.col("code").alias("_code"), F.col("titled").alias("_titled"))
    both = joined(full, other, ("session_id", "first", "last")).filter((F.col("name") != F.col("match_name")) & apart)
    both = both.select("session_id", F.when(F.col("_titled") & F.col("shared_last"), 1).otherwise(0).alias("phase"), F.col("name").alias("primary_name"), "match_name")
    # Single names: a full name holds the word; it is open whose it is if it is the first name of several.
    firsts = full.filter("shared_first").select("session_id", F.col("first").alias("word"), F.lit(True).alias("_open")).distinct()
    held = full.select("session_id", F.col("name").alias("primary_name"), "code", F.explode(F.array_distinct("parts")).alias("word"))
    met = joined(joined(single, firsts, ("session_id", "word"), "left"), held, ("session_id", "word")).filter(apart)
    met = met.select("session_id", F.when(F.col("_open"), 1).otherwise(0).alias("phase"), "primary_name", "match_name")
    # Single names among themselves: equal words, or one that begins with the other.
    longer = single.select("session_id", F.col("match_name").alias("primary_name"), F.col("_code").alias("code"), F.col("word").alias("_long"), F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("word"))
    alike = joined(longer, single, ("session_id", "word")).filter((F.col("primary_name") != F.col("match_name")) & apart)
    alike = alike.select("session_id", F.lit(2).alias("phase"), "primary_name", "match_name")
    return both.unionByName(met).unionByName(alike)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order, kept or dropped; only the taken names of the session at hand are held."""
    session, begun, taken = None, False, set()
    at, free = None, False  # the name whose pairs are gone through, and whether it was free when they began
    ending = None  # a match whose open pairs have all been given
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if not begun or x["session_id"] != session:
                session, begun, taken, at, ending = x["session_id"], True, set(), None, None
            lead = x["match_name"] if x["phase"] == 1 else x["primary_name"]
            if at != (x["phase"], lead):
                if ending is not None:
                    taken.add(ending)
                at, free, ending = (x["phase"], lead), lead not in taken, None
            if not free:
                continue
            if x["phase"] == 1:
                ending = lead
                if x["primary_name"] not in taken:
                    out.append((session, x["primary_name"], lead, "low"))
            elif x["match_name"] not in taken:
                taken |= {x["match_name"], lead}
                out.append((session, lead, x["match_name"], "low" if x["phase"] else "high"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=[f.split()[0] for f in GROUPS.split(", ")])


def duplicate_persons(names: DataFrame) -> DataFrame:
    """(session_id, primary_name, match_name, confidence) from distinct (session_id, name) with, if known, their `code`."""
    pairs = candidate_pairs(names)
    lead, other = F.when(F.col("phase") == 1, F.col("match_name")).otherwise(F.col("primary_name")), F.when(F.col("phase") == 1, F.col("primary_name")).otherwise(F.col("match_name"))
    order = [F.lower(lead).alias("_a"), lead.alias("_b"), F.lower(other).alias("_c"), other.alias("_d")]
    ordered = pairs.distinct().select("session_id", "phase", "primary_name", "match_name", *order).repartition("session_id").sortWithinPartitions("session_id", "phase", "_a", "_b", "_c", "_d")
    return ordered.select("session_id", "phase", "primary_name", "match_name").mapInArrow(_taken, GROUPS)


def in_order(groups: DataFrame) -> DataFrame:
    """Groups with `rank` in their session: the sure ones first, then by the primary's name, then the match's."""
    order = (F.when(F.col("confidence") == "high", 0).otherwise(1), F.lower("primary_name"), "primary_name", "match_name")
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)).cast("long"))
