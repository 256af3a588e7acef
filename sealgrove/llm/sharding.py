"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node its key takes part in a weighted draw: child c gets the time
-ln(u) / weight(c), u being a hash of the key and of c's path, and the earliest child wins. A child's share is its
weight's share, and when one child's weight changes, only rows that move into it or out of it move: the other
children's times stay as they were. Movement is therefore confined to the subtrees whose weights change. A shard
that joins as a subtree of its own (a new region) takes rows only into itself.

Edge cases: a null key is a key like any other, equal keys always meet in one shard, empty tables give empty tables;
existing columns named shard, slot or grown_shard are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealgrove.llm.texts import carried, others, unpacked
from sealgrove.sources.tables import read_table

#: Slots are counted within buckets of a shard, so that no task needs a whole shard; the offsets have one row for each of them.
SLOT_BUCKETS = 4096
DRAWS = 1 << 52


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: Two regions of two racks of two shards.
EIGHT = tuple(Leaf(f"r{s // 4}", f"k{s // 2 % 2}", s) for s in range(8))
#: One shard more, as a region of its own.
NINE = (*EIGHT, Leaf("r2", "k0", 8))


def _time(key: Column, path: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{path}|"), key).cast("binary")), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(DRAWS))) / F.lit(float(weight))


def _draw(key: Column, path: str, children: dict[str, float]) -> Column:
    """The child of the node `path` that wins the draw; equal times go to the smaller name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    times = [F.struct(_time(key, f"{path}/{c}", w).alias("t"), F.lit(c).alias("c")) for c, w in sorted(children.items())]
    return F.array_min(F.array(*times))["c"]


def shard_of(key: Column, leaves: tuple[Leaf, ...]) -> Column:
    """The shard of a key as an expression: draws along one path of the tree. Leaves without weight get nothing."""
    key = F.coalesce(key.cast("string"), F.lit("\x00"))
    tree: dict[str, dict[str, dict[str, float]]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            tree.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[str(leaf.shard)] = leaf.weight
    if not tree:
        raise ValueError("no leaf has a weight")

    def pick(chosen: Column, by: dict[str, Column]) -> Column:
        if len(by) == 1:
            return next(iter(by.values()))
        out = None
        for name, value in by.items():
            out = F.when(chosen == name, value) if out is None else out.when(chosen == name, value)
        return out

    regions = {r: sum(w for rack in racks.values() for w in rack.values()) for r, racks in tree.items()}
    by_region = {}
    for r, racks in tree.items():
        weights = {k: sum(shards.values()) for k, shards in racks.items()}
        by_rack = {k: _draw(key, f"/{r}/{k}", shards) for k, shards in racks.items()}
        by_region[r] = pick(_draw(key, f"/{r}", weights), by_rack)
    return pick(_draw(key, "", regions), by_region).cast("int")


def shard_rows(df: DataFrame, key: str = "doc_id", leaves: tuple[Leaf, ...] = EIGHT, grown: tuple[Leaf, ...] | None = None, tie: str | None = None) -> DataFrame:
    """`df` with `shard`, `slot` (gapless from 0 in each shard) and, given a tree `grown`, `grown_shard`.

    Slots are dealt in two steps: rows are counted in buckets of a shard, a small table of bucket offsets is made of the
    counts, and rows are numbered within their bucket. Rows of equal key go into buckets by the column `tie`, as null may be the key of
    many rows, and are numbered in its order; without it in any.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    by = [F.col(key), F.col(tie)] if tie else [F.col(key)]
    if tie:
        name = F.concat(name, F.lit("|"), F.coalesce(F.col(tie).cast("string"), F.lit("\x00")))
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), name).cast("binary")), 1, 3), 16, 10).cast("int")
    columns = {"_key": F.struct(*by), "_shard": shard_of(F.col(key), leaves), "_bucket": bucket}
    if grown is not None:
        columns["_grown"] = shard_of(F.col(key), grown)
    rows = carried(df, **columns)
    counts = rows.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.withColumn("_number", F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_key")))
    # The offsets have a row for each bucket of each shard at most, whatever the input: a broadcast of bounded size.
    out = numbered.join(F.broadcast(offsets), ["_shard", "_bucket"])
    new = [F.col("_shard").alias("shard"), (F.col("_offset") + F.col("_number") - 1).cast("long").alias("slot")]
    new += [F.col("_grown").alias("grown_shard")] if grown is not None else []
    return out.select(*unpacked(out, others(df, "shard", "slot", *(["grown_shard"] if grown is not None else []))), *new)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(docs, "doc_id", EIGHT, NINE, tie="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_time(path: str, weight: float) -> str:
    return f"(-ln((('0x' || substr(md5('{path}|' || k), 1, 13))::bigint + 0.5) / {DRAWS}.0) / {float(weight)})"


def _sql_draw(path: str, children: dict[str, tuple[float, str]]) -> str:
    """Children by name: weight and the SQL for what lies below."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    best = "least(" + ", ".join(_sql_time(f"{path}/{c}", w) for c, (w, _) in children.items()) + ")"
    return "case " + " ".join(f"when {_sql_time(f'{path}/{c}', w)} = {best} then {below}" for c, (w, below) in sorted(children.items())) + " end"


def _sql_shard(leaves: tuple[Leaf, ...]) -> str:
    tree: dict[str, dict[str, dict[str, tuple[float, str]]]] = {}
    for x in leaves:
        tree.setdefault(x.region, {}).setdefault(x.rack, {})[str(x.shard)] = (x.weight, str(x.shard))
    total = lambda d: sum(w for w, _ in d.values())
    regions = {}
    for r, racks in tree.items():
        below = {k: (total(shards), _sql_draw(f"/{r}/{k}", shards)) for k, shards in racks.items()}
        regions[r] = (total(below), _sql_draw(f"/{r}", below))
    return _sql_draw("", regions)


SQL = f"""
with recursive crc_steps(i, c, k) as (
  select i, i, 0 from range(256) t(i)
  union all
  select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8),
crc_table as (select list(c order by i) as steps from crc_steps where k = 8),
docs as (
  select doc_id, coalesce(cast(doc_id as varchar), chr(0)) as k, coalesce(octet_length(encode(text)), 0) + 1 as size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint),
      lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295) as text_crc32
  from documents, crc_table),
placed as (
  select *, {_sql_shard(EIGHT)} as shard, {_sql_shard(NINE)} as grown_shard, ('0x' || substr(md5('slot|' || k || '|' || text_crc32::bigint), 1, 3))::int as bucket
  from docs)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  (row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32) - 1)::bigint as slot, grown_shard::int as grown_shard
from placed
"""

QUERIES = {"op8_sharding": op8_sharding}
ORACLES = {"op8_sharding": SQL}
