"""Exact top-k search by distributed histogram selection.

All candidates are scored against all queries, in groups of blocks, and all scores are counted in a histogram for each query and group; the histograms' sums narrow each query's
interval to the bin that holds its k-th largest score. The scores are then computed once more, and those that reach their query's interval are kept; further rounds count these in finer
histograms until the interval is one score wide, and this is the k-th value. At last, scores above it are kept and, of those equal to it, the smallest ids that are still needed.

What can't matter doesn't leave a group: bins below that in which the group itself has k scores, and of the scores that reach the interval all but the k best of a pair of blocks (of equal ones
those of the smallest ids). So a query and a group give at most k rows of the histogram, and counts of all bins that can hold the k-th score are whole.
Vectors are shuffled twice, not in the rounds; a block is copied once for each group of up to GROUP blocks of the other side. Groups meet by numbers that are hashes of their blocks'; the
driver learns how many blocks there are, and nothing of their rows.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; an empty vector scores 0 with
all, and shorter vectors count as filled up with zeros; rows of an equal id are candidates each, and a query of that id leaves all of
them out; if several rows have a query's id, the smallest vector asks. With fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealgrove.sources.tables import read_table, written

#: Rows of a block of queries and of candidates: a pair of blocks scores 4 million pairs in 32 MB.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Blocks of either side that meet in one task, about: 16,384 queries and 65,536 candidates, 10 MB of vectors of 64 small numbers.
GROUP = 16
#: A round divides an interval into 2 ** 10 bins.
BIN_BITS = 10
PACKED = "block long, ids binary, vectors binary, kind string, dim int, norm double, lows binary"
COUNTED = "qid long, bin long, n long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v) of the rows that take part, each component x as floor(scale * x)."""
    x = F.col(embedding)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    out = vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return out.select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))


def _pack(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, ids, rows, lows = TaskContext.get().partitionId() << 32, [], [], []

        def block():
            dim = max(map(len, rows))
            m = np.zeros((len(rows), dim), dtype=np.int64)
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            small = next(t for t in (np.int16, np.int32, np.int64) if m.min(initial=0) >= np.iinfo(t).min and m.max(initial=0) <= np.iinfo(t).max)
            norm = float((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
            packed = {"ids": np.array(ids, dtype=np.int64).tobytes(), "vectors": m.astype(small).tobytes(), "kind": np.dtype(small).name, "dim": dim, "norm": norm, "lows": np.array(lows, dtype=np.int64).tobytes()}
            return pd.DataFrame({"block": [number]} | {name: [x] for name, x in packed.items()})

        for batch in batches:
            for i, v, low in zip(batch["id"], batch["v"], batch["lo"] if "lo" in batch else [0] * len(batch), strict=True):
                ids.append(i)
                rows.append(v)
                lows.append(low)
                if len(rows) == size:
                    yield block()
                    number, ids, rows, lows = number + 1, [], [], []
        if rows:
            yield block()

    return pack


def _unpacked(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["vectors"], dtype=row["kind"]).reshape(len(row["ids"]) // 8, int(row["dim"]))


def _scores(q: pd.Series, c: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, scores and which of them count."""
    (qi, a), (ci, b) = _unpacked(q), _unpacked(c)
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim].astype(np.int64), b[:, :dim].astype(np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim < 2**53:  # every partial sum is an exact double
        s = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    else:
        s = a @ b.T
    return qi, ci, s, qi[:, None] != ci[None, :]


def _counted(k: int, bits: int):
    """For groups of query blocks and candidate blocks: each query's histogram of all scores, from the top down to the bin in which the k-th of the group lies; bins, counted from 0 up and down, divide [-2 ** (bits - 1), 2 ** (bits - 1))."""

    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        for _, q in qs.iterrows():
            counts = np.zeros((len(q["ids"]) // 8, 1 << BIN_BITS), dtype=np.int64)
            for _, c in cs.iterrows():
                qi, _, s, valid = _scores(q, c)
                bins = (s >> (bits - BIN_BITS)) + (1 << (BIN_BITS - 1)) + (np.arange(len(qi)) << BIN_BITS)[:, None]
                counts += np.bincount(bins.ravel() if valid.all() else bins[valid], minlength=counts.size).reshape(counts.shape)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            row, bin_ = np.nonzero((counts > 0) & (above < k))
            out.append((np.frombuffer(q["ids"], dtype=np.int64)[row], bin_ - (1 << (BIN_BITS - 1)), counts[row, bin_]))
        return pd.DataFrame(dict(zip(("qid", "bin", "n"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


def _reaching(k: int):
    """For groups of query blocks and candidate blocks: the scores from the queries' lows on; of more than k of a candidate block the k best, of equal ones those of the smallest ids."""

    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        for _, q in qs.iterrows():
            lows = np.frombuffer(q["lows"], dtype=np.int64)
            for _, c in cs.iterrows():
                qi, ci, s, valid = _scores(q, c)
                kept = valid & (s >= lows[:, None])
                for i in np.flatnonzero(kept.sum(axis=1) > k):
                    own = np.flatnonzero(kept[i])
                    kept[i, own[np.lexsort((ci[own], -s[i, own]))[k:]]] = False
                row, col = np.nonzero(kept)
                out.append((qi[row], ci[col], s[row, col]))
        return pd.DataFrame(dict(zip(("qid", "vec_id", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


def _met(left: DataFrame, right: DataFrame, n: int, m: int):
    """All pairs of n groups of blocks with m groups of others."""
    number = lambda df, own, size, other, count: df.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(size))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")))
    return number(left, "qg", n, "cg", m).groupBy("qg", "cg").cogroup(number(right, "cg", m, "qg", n).groupBy("qg", "cg"))


def _narrowed(counts: DataFrame, step: int) -> DataFrame:
    """(qid, lo, need) after a round: the bin of the k-th score, and how many of the k best are in it, from counts (qid, lo, need, bin, n)."""
    above = F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("above", F.coalesce(above, F.lit(0)))
    # The k-th score is in the last bin from the top that has fewer than the needed above it; with too few candidates this is the lowest one.
    found = counts.filter(F.col("above") < F.col("need")).groupBy("qid").agg(F.min(F.struct("bin", "above", "lo", "need")).alias("b"))
    return found.select("qid", (F.col("b.lo") + F.col("b.bin") * step).alias("lo"), (F.col("b.need") - F.col("b.above")).alias("need"))


def kth_values(scored: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """(qid, kth, need): each query's k-th largest score and how many of it are among the k best; the lowest score if there are fewer than k.

    It lies in [lo, lo + width) of `state` (qid, lo, need). Each round counts the scores within the queries' intervals in 2 ** BIN_BITS bins and goes on with the bin of the k-th.
    """
    while width > 1:
        step = max(1, width >> BIN_BITS)
        inside = scored.join(state, "qid").filter(F.col("score").between(F.col("lo"), F.col("lo") + F.lit(width - 1)))
        counts = inside.groupBy("qid", "lo", "need", F.expr(f"(score - lo) div {step}").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        state, width = written(_narrowed(counts, step), "topk-state"), step
    return state.withColumnRenamed("lo", "kth")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id, v) tables of integer vectors; ties go to the smaller id."""
    spark = vectors.sparkSession
    cands = written(vectors.mapInPandas(_pack(CANDIDATE_BLOCK), PACKED), "topk-candidates")
    queries = written(queries.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    n_asked = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = lambda df: written(df.repartition(n_asked, "id").mapInPandas(_pack(QUERY_BLOCK), PACKED), "topk-blocks")
    asked, n_cands = packed(queries), max(1, cands.count())
    # As few groups as GROUP allows, but enough for all tasks.
    qgs, tasks = -(-n_asked // GROUP), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cgs = min(n_cands, max(-(-n_cands // GROUP), -(-tasks // qgs)))
    longest = lambda blocks: blocks.agg(F.max("norm")).first()[0] or 0.0
    bits = min(64, max(BIN_BITS, (2 * (int((longest(asked) * longest(cands)) ** 0.5) + 2)).bit_length()))  # Cauchy-Schwarz bounds all scores
    step = 1 << (bits - BIN_BITS)
    counts = _met(asked, cands, qgs, cgs).applyInPandas(_counted(k, bits), COUNTED).groupBy("qid", "bin").agg(F.sum("n").alias("n"))
    state = written(_narrowed(counts.withColumns({"lo": F.lit(0).cast("long"), "need": F.lit(k).cast("long")}), step), "topk-state")
    asked = packed(queries.join(state.select(F.col("qid").alias("id"), "lo"), "id"))
    scored = written(_met(asked, cands, qgs, cgs).applyInPandas(_reaching(k), "qid long, vec_id long, score long"), "topk-scores")
    values = kth_values(scored, state, step)
    scored = scored.join(values, "qid")
    ties = scored.filter("score = kth").withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("vec_id"))).filter("nth <= need").drop("nth")
    best = scored.filter("score > kth").unionByName(ties)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return best.select(F.col("qid").alias("query_id"), rank.cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.vec_id as query_id, c.vec_id, coalesce(list_dot_product(q.v, c.v), 0)::bigint as score
  from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

QUERIES = {"op7_topk": op7_topk}
ORACLES = {"op7_topk": SQL}
