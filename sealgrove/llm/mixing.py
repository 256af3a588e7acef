"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are ordered within their source by a seeded hash, and the hash range is cut into BLOCKS blocks: a permutation in
blocks, drawn without moving a row. A source's target fixes how many block draws it gives: whole rounds over its blocks, then
the first blocks of one more round, then the first documents of the block in which the target lies. The tree deals these exact
quotas to output shards: at each node half of the shards get a multivariate-hypergeometric draw of the node's quotas, the others
the rest, so the leaves' quotas add up to the sources' exactly. Shards then draw disjoint runs of the permuted blocks, and a
shuffle within each shard orders its rows by another hash.

Sources are dealt weights by code point, null last, repeating `weights`. Targets share `share` times all sizes by weight; a target
stops at `cap` times its source's size, and the excess is shared again among the others until none is above.

Edge cases: null text has size 0 and null is a source; rows of equal doc_id share one fate, rows without one if their texts are equal; a source without words has target 0;
an empty table gives an empty table; existing columns
of the outputs' names are replaced. The draws depend on the seed, doc_id, source and sizes only, so reruns agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealgrove.llm.texts import carried, n_words, others, unpacked
from sealgrove.sources.tables import read_table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SHARDS = 16
SEED = 17
#: Blocks of a source; 2 ** 12, the first 12 of a document's 60 hash bits.
BLOCK_BITS, HASH_BITS = 12, 60
BLOCKS = 1 << BLOCK_BITS
#: The plan has a row for each source. Up to so many rows it is broadcast, beyond that it is joined by source.
BROADCAST_SOURCES = 10_000


def position(doc_id: Column, text: Column, salt: str) -> Column:
    """A document's place in a permutation: 60 bits of a salted digest of its id, or of its text where it has none."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("\x00"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}|"), name).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """A target for each source, in the order of the sources."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if rest * w[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * w[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        rest -= sum(out[i] for i in over)
        closed = set(over)
        open_ = [i for i in open_ if i not in closed]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int, path: str = "") -> np.ndarray:
    """Quotas by shard and source: the leaves of the splitting tree, which add up to `quotas`."""
    if shards == 1:
        return quotas[None, :]
    left, total = shards // 2, int(quotas.sum())
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{path}".encode()).digest()[:8], "little"))
    drawn = np.zeros_like(quotas)
    need, rest = total * left // shards, total
    for i, q in enumerate(quotas):  # a multivariate hypergeometric draw, one source after the other
        rest -= int(q)
        drawn[i] = rng.hypergeometric(int(q), rest, need) if q and need and rest else min(int(q), need)
        need -= int(drawn[i])
    return np.vstack([split_quotas(drawn, left, seed, path + "0"), split_quotas(quotas - drawn, shards - left, seed, path + "1")])


def mix_plan(
    df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """A row for each source: _source, source_size, target, _cut and _ends.

    A source's draws are numbered round by round: draw c * BLOCKS + b takes block b for the c-th time. _ends are the ends of the shards' runs of
    draws, cumulated leaves of the tree; the last draw takes the documents up to _cut only, if _cut isn't negative. The driver gets a row for
    each source, nothing of documents.
    """
    spark = df.sparkSession
    slim = written(df.select(F.col(source).alias("_source"), position(F.col(doc_id), F.col(text), str(seed)).alias("_h"), n_words(F.col(text)).alias("_size")), "mix-sizes")
    block = F.shiftright("_h", HASH_BITS - BLOCK_BITS)
    blocks = written(slim.groupBy("_source", block.alias("_block")).agg(F.sum("_size").alias("_words")), "mix-blocks")
    rows = blocks.groupBy("_source").agg(F.sum("_words").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [int(r["n"]) for r in rows]
    goal = targets(sizes, weights, share, cap)
    rounds = [min(int(t // s), int(cap)) if s else 0 for t, s in zip(goal, sizes, strict=True)]
    rest = [t - k * s for t, k, s in zip(goal, rounds, sizes, strict=True)]
    schema = "_source string, source_size long, target double, _rounds int, _rest double"
    by_source = spark.createDataFrame([(r["_source"], s, t, k, x) for r, s, t, k, x in zip(rows, sizes, goal, rounds, rest, strict=True)], schema)

    # The block in which the rest ends, and of its documents those that bring the sum nearest to it.
    same = lambda a, b: F.expr(f"{a}._source <=> {b}._source")
    small = (lambda d: F.broadcast(d)) if len(rows) <= BROADCAST_SOURCES else (lambda d: d)
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    sums = sums.alias("a").join(small(by_source).alias("b"), same("a", "b")).select("a._source", "_block", "_before", "_rest")
    reached = sums.filter(F.col("_before") <= F.col("_rest")).groupBy("_source").agg(F.max_by(F.struct("_block", "_before", "_rest"), "_block").alias("_b"))
    reached = reached.select("_source", "_b._block", "_b._before", "_b._rest")
    inside = slim.withColumn("_block", block).alias("a").join(small(reached).alias("b"), same("a", "b") & F.expr("a._block = b._block"))
    inside = inside.groupBy("b._source", "_h", "_before", "_rest").agg(F.sum("_size").alias("_size"))
    upto = F.col("_before") + F.sum("_size").over(Window.partitionBy("_source").orderBy("_h"))
    inside = inside.withColumn("_upto", upto).filter(F.col("_upto") - F.col("_size") / 2 <= F.col("_rest"))
    cuts = inside.groupBy("_source").agg(F.max("_h").alias("_cut"))
    ends = {r["_source"]: (r["_block"], r["_cut"]) for r in reached.alias("a").join(cuts.alias("b"), same("a", "b"), "left").select("a._source", "_block", "_cut").collect()}

    full = [int(ends.get(r["_source"], (0, None))[0] or 0) for r in rows]
    cut = [ends.get(r["_source"], (0, None))[1] for r in rows]
    quotas = np.array([k * BLOCKS + f + (c is not None) for k, f, c in zip(rounds, full, cut, strict=True)], dtype=np.int64)
    leaves = np.cumsum(split_quotas(quotas, shards, seed), axis=0) if len(rows) else np.zeros((shards, 0), dtype=np.int64)
    plan = [(r["_source"], s, t, -1 if c is None else int(c), leaves[:, i].tolist()) for i, (r, s, t, c) in enumerate(zip(rows, sizes, goal, cut, strict=True))]
    return small(spark.createDataFrame(plan, "_source string, source_size long, target double, _cut long, _ends array<long>"))


def mixed(df: DataFrame, plan: DataFrame, source: str = "source", place: Column | None = None, cap: float = CAP) -> DataFrame:
    """`df` with source_size, target and `shards`: the shard of each draw of the tree's leaves that takes the row. `place`: position() of the row."""
    rows = carried(df, _h=place, _own=F.col(source))
    out = rows.join(plan, F.col("_own").eqNullSafe(F.col("_source"))).withColumn("_block", F.shiftright("_h", HASH_BITS - BLOCK_BITS))
    drawn = F.element_at("_ends", F.lit(-1))
    whole = F.when(F.col("_cut") >= 0, drawn - 1).otherwise(drawn)  # draws of whole blocks
    draws = F.transform(F.sequence(F.lit(0), F.lit(int(cap))), lambda c: c * BLOCKS + F.col("_block"))
    taken = F.filter(draws, lambda d: (d < whole) | ((d == whole) & (d < drawn) & (F.col("_h") <= F.col("_cut"))))
    shard = F.transform(taken, lambda d: F.size(F.filter(F.col("_ends"), lambda e: e <= d)))
    return out.select(*unpacked(out, others(df, "source_size", "target", "shards")), "source_size", "target", shard.alias("shards"))


def mix_sources(df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = SEED, local_shuffle: bool = True, **options) -> DataFrame:
    """The mix: a row of `df` for each copy taken, with `shard`, in each shard in an order of its own."""
    plan = mix_plan(df, source, doc_id, text, seed=seed, **options)
    slim = carried(df, doc_id=F.col(doc_id), source=F.col(source), place=position(F.col(doc_id), F.col(text), str(seed)))
    taken = mixed(slim, plan, "source", F.col("place")).select("_row", "place", F.posexplode("shards").alias("copy", "shard"))
    if local_shuffle:
        order = F.xxhash64(F.lit(seed), F.col("shard"), F.col("copy"), F.col("place"))
        # Shards are dealt in pieces by the same hash, so that no task needs a whole shard.
        taken = taken.repartition(F.col("shard"), F.pmod(order, F.lit(64))).sortWithinPartitions("shard", order)
    return taken.select(*unpacked(taken, others(df, "shard")), "shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), position(F.col("doc_id"), F.col("text"), str(SEED)).alias("place"))
    out = mixed(slim, mix_plan(docs), "source", F.col("place")).withColumn("copies", F.size("shards"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


SQL = f"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id as varchar), chr(0) || md5(coalesce(text, '')))), 1, 15))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as n, case (row_number() over (order by source is null, encode(source)) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
  from docs group by source),
caps as (
  select *, ({SHARE} * sum(n) over ())::double as total, sum({CAP} * n) over (order by {CAP} * n / w, source rows between unbounded preceding and 1 preceding) as below,
    sum(w) over (order by {CAP} * n / w, source rows between current row and unbounded following) as open_w
  from sources),
capped as (select *, {CAP} * n < (total - coalesce(below, 0)) * w / open_w as is_capped from caps),
goals as (
  select source, n, case when is_capped then ({CAP} * n)::double
    else (total - coalesce(sum({CAP} * n) filter (where is_capped) over (), 0)::double) * w / sum(w) filter (where not is_capped) over () end as target
  from capped),
parts as (select *, case when n > 0 then least(floor(target / n), {CAP})::int else 0 end as rounds from goals),
ordered as (
  select d.*, p.n, p.target, p.rounds, p.target - p.rounds * p.n as rest,
    sum(size) over (partition by d.source order by h) as upto, sum(size) over (partition by d.source, h) as here
  from docs d join parts p on d.source is not distinct from p.source)
select doc_id, size, n as source_size, target, (size * copies)::bigint as taken, copies::int as copies
from (select *, rounds + case when upto - here / 2.0 <= rest then 1 else 0 end as copies from ordered)
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": SQL}
