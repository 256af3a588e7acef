"""Edits in sequence, and chains of merges.

A log holds edits of sessions' codes in order: `replayed` gives the codes after all of them, each edit seeing those before it. Sessions are sorted by Spark and replayed as a stream of batches:
a task holds the codes of one session at a time, however long its log is. A session's edits are a sequence, so one session is the work of one task.

Log: (session_id, at, kind, key, original, type, code, primary). Keys are lower-case and trimmed; `at` orders a session's edits and is its own for each; columns that a kind doesn't need may be null.

* add (key, original, type): the key gets the next code of the type, unless it has a code
* set (key, original, type, code): the key gets this code
* update (key, original, type, code): the same if the key has a code, else nothing
* reclassify (key, original, type): the key gets the next code of the type, whether it had one or not
* remove (key): the key has no code any more; remove_group (key): nor have all keys of its base
* merge (key, original, primary): the key shares the base of the primary, if that has a code, else nothing
* clear: the session begins anew, numbers included

Numbers of a type never go back: a number that was dealt since the session began is not dealt again, whether or not a key still has it, and numbers that a key has by a code of the user's are passed over.

Edge cases: a null session is a session; an unknown kind does nothing; edits of a key that isn't there do nothing, but for add, set and reclassify; a key merged with itself stays; an empty log leaves the
codes as they are but for persons' variants of merged keys, which are told anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealgrove.functions import codes as c
from sealgrove.functions import names as fn
from sealgrove.functions.words import PREFIXES
from sealgrove.operators.joins import joined, numbered
from sealgrove.sources.tables import written

LOG = "session_id string, at long, kind string, key string, original string, type string, code string, primary string"
STATE = "session_id string, key string, base_id string, merged string, type string, original string, variant string, owner string, anchor boolean"
KEY = ("session_id", "key")


def prefix_of(type: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))[type]


def counters(codes: DataFrame) -> DataFrame:
    """(session_id, prefix, next): the number behind the highest that a session's codes have for a prefix."""
    n = codes.select("session_id", F.substring_index("base_id", "_", 1).alias("prefix"), c.letter_index(F.substring_index("base_id", "_", -1)).alias("_n"))
    return n.groupBy("session_id", "prefix").agg((F.max("_n") + 1).alias("next"))


def dealt(new: DataFrame, next_: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """`new` (session_id, type, at and other columns) with a base_id each: in order of `at`, the numbers from `next_` (session_id, prefix, next) on that no base of `used` (session_id, base_id) has."""
    own = numbered(new, ("session_id", "type"), ("at",), "_n").withColumn("prefix", prefix_of(F.col("type")))
    own = joined(own, next_, ("session_id", "prefix"), "left").withColumn("_n", F.col("_n") + F.coalesce("next", F.lit(0))).drop("next")
    if used is not None:
        taken = used.select("session_id", F.substring_index("base_id", "_", 1).alias("prefix"), c.letter_index(F.substring_index("base_id", "_", -1)).alias("_u")).filter("_u is not null")
        taken = joined(taken, next_, ("session_id", "prefix"), "left").filter(F.col("_u") >= F.coalesce("next", F.lit(0)))
        taken = taken.groupBy("session_id", "prefix").agg(F.array_sort(F.collect_set("_u")).alias("_taken"))
        passed = F.aggregate("_taken", F.col("_n").cast("long"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
        own = joined(own, taken, ("session_id", "prefix"), "left").withColumn("_n", F.coalesce(passed, F.col("_n"))).drop("_taken")
    return own.withColumn("base_id", c.base_id(F.col("type"), F.col("_n"))).drop("_n", "prefix")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions' edits one after the other, as they are sorted; only the codes of the session at hand are held."""
    schema = pa.schema([(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.string()) for f in STATE.split(", ")])
    session, begun = None, False
    held: dict[str, list] = {}  # key: its base, and the text it was merged under or None
    bases: dict[str, list] = {}  # base: type, original, variant, owner, anchor
    next_: dict[str, int] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        out = [dict(zip(schema.names, (session, key, base, text, *bases[base]), strict=True)) for key, (base, text) in held.items()]
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[k : k + 10_000], schema=schema)

    def put(key: str, base: str, x: dict, variant: str | None = None, anchor: bool = False) -> None:
        held[key], bases[base] = [base, None], [x["type"], x["original"], variant, key, anchor]

    def deal(x: dict) -> None:
        prefix = PREFIXES[x["type"]]
        n, used = next_.get(prefix, 0), {b for b, _ in held.values()} if any(b.startswith(prefix) for b in foreign) else ()
        while f"{prefix}_{c.letters_of(n)}" in used:
            n += 1
        next_[prefix] = n + 1
        put(x["key"], f"{prefix}_{c.letters_of(n)}", x)

    foreign: set[str] = set()  # bases that the user has set
    for batch in batches:
        for x in batch.to_pylist():
            if not begun or x["session_id"] != session:
                if begun:
                    yield from rows()
                session, begun = x["session_id"], True
                held, bases, next_, foreign = {}, {}, {}, set()
            kind, key = x["kind"], x["key"]
            if kind == "clear":
                held, bases, next_, foreign = {}, {}, {}, set()
            elif kind == "code":  # of before the log
                prefix, n = x["base_id"].split("_")[0], c.index_of(x["base_id"].split("_")[-1])
                next_[prefix] = max(next_.get(prefix, 0), n + 1)
                if x["base_id"] in bases and not x["anchor"]:
                    held[key] = [x["base_id"], x["original"]]
                else:
                    put(key, x["base_id"], x, x["variant"], x["anchor"])
            elif kind == "add" and key not in held or kind == "reclassify":
                deal(x)
            elif kind == "set" or kind == "update" and key in held:
                foreign.add(x["base_id"])
                if any(base == x["base_id"] for k, (base, _) in held.items() if k != key):  # a code that others have: the key joins them
                    held[key] = [x["base_id"], x["original"]]
                else:
                    put(key, x["base_id"], x, x["variant"])
            elif kind == "remove":
                held.pop(key, None)
            elif kind == "remove_group" and key in held:
                base = held[key][0]
                held = {k: v for k, v in held.items() if v[0] != base}
            elif kind == "merge" and x["primary"] in held and x["primary"] != key:
                base = held[x["primary"]][0]
                held[key] = [base, x["original"] or key]
                bases[base][4] = True
    if begun:
        yield from rows()


def replayed(codes: DataFrame, log: DataFrame) -> DataFrame:
    """`codes` (session_id, key, original, type, code, base_id, variant, anchor) after the log.

    A merged key restores to the form of the primary's name that it is, and the primary shows as FULL or FIRST_LAST, as for merges one by one.
    """
    start = codes.select("session_id", F.lit(None).cast("long").alias("at"), F.when(F.col("anchor"), 0).otherwise(1).alias("_first"), F.lit("code").alias("kind"), "key", "original", "type", "base_id", "variant", "anchor", F.lit(None).cast("string").alias("primary"))
    edits = log.withColumns({"_first": F.lit(2), "base_id": c.base_of(F.col("code")), "variant": c.variant_of(F.col("code")), "anchor": F.lit(False)})
    events = start.unionByName(edits.select(*start.columns))
    state = events.repartition("session_id").sortWithinPartitions("session_id", "_first", "at", "key").drop("_first").mapInArrow(_replay, STATE)
    alias = (F.col("owner") != F.col("key")) | F.col("merged").isNotNull()
    name, text = F.col("original"), F.coalesce("merged", "key")
    p, full = fn.person(name), fn.strip_title(name)
    part = F.coalesce(fn.variant_for(text, p, full), F.when(F.contains(text, F.lit(" ")), "FIRST_LAST").otherwise("FIRST"))
    person = F.col("type").startswith("person")
    forms = fn.variants(p, full)
    shown = F.when(person, F.element_at(F.create_map(*(x for k, v in forms.items() for x in (F.lit(k), v))), part)).otherwise(name)
    raised = F.when(p["middle"].isNotNull(), "FULL").otherwise("FIRST_LAST")
    own = F.coalesce("variant", F.when(F.col("anchor") & person, raised))
    out = state.select(
        *KEY, F.when(alias, shown).otherwise(name).alias("original"), "type", "base_id", F.when(alias, F.when(person, part)).otherwise(own).alias("variant"), (~alias & person & F.col("anchor")).alias("anchor"))
    return out.select(*KEY, "original", "type", c.with_variant(F.col("base_id"), F.col("variant")).alias("code"), "base_id", "variant", "anchor")


def chained(links: DataFrame) -> DataFrame:
    """(session_id, alias, primary): where links (session_id, alias, primary) between keys end, for every alias.

    Pointer jumping: each round doubles the way a link spans, so that a chain of a thousand takes ten. A key with several primaries follows the smallest; links to itself and null keys don't count. Keys that
    lead into a circle end at the circle's smallest key, which itself has no row.
    """
    first = links.filter("alias is not null and primary is not null and alias <> primary").groupBy("session_id", "alias").agg(F.min("primary").alias("primary"))
    # `least` is the smallest key from the primary on over the span; `done`: the primary has no link.
    state = written(first.withColumn("least", F.col("primary")), "links")
    n, span = state.count(), 1
    while True:
        ahead = state.select("session_id", F.col("alias").alias("primary"), F.col("primary").alias("_next"), F.col("least").alias("_least"))
        moved = joined(state, ahead, ("session_id", "primary"), "left")
        open_ = F.col("_next").isNotNull()
        if moved.filter(open_).isEmpty():
            return state.select("session_id", "alias", "primary")
        if span > n:  # whoever isn't done goes round; from a key on a circle the span holds all of it
            ring = F.coalesce(F.least("_least", "primary"), F.col("primary"))
            return moved.select("session_id", "alias", F.when(open_, ring).otherwise(F.col("primary")).alias("primary")).filter("alias <> primary")
        state = written(moved.select("session_id", "alias", F.coalesce("_next", "primary").alias("primary"), F.least("least", "_least").alias("least")), "links")
        span *= 2
