"""Induction over grams of any number of blocks: groups too large for a task are split by longer common contexts.

A group's blocks agree in `lo` bytes to the left of their sample and in `window - hi` bytes from it on: they can share the windows that
start `lo` to `hi` bytes to the left of the sample, and no others. A group of up to `group` blocks is sorted and induced in one task
(suffixes.shared). A larger one is cut in two, which take half of the range each and so agree in more bytes; its blocks meet again by the
longer context, and what does not share it parts. After some five rounds a range is one window: all rows of a group are equal then, and
the least document is an aggregate, combined before the shuffle. Suffixes and ranges move through Spark's sorts, which spill; each
round is a table in the shared folder.

Contexts are hashed only to bring blocks together; windows are compared by their bytes.

Edge cases: no blocks give no runs; blocks that repeat in one document never remove one another; runs may come twice where both halves find them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrove.llm import suffixes
from sealgrove.sources.tables import written

BLOCK = "id long, nth long, at long, n int, sample int, own binary"
RUN = "id long, at long, n int"


def _small(window: int):
    """Runs of one window each that a bucket of groups shares with a smaller document."""

    def run(t: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(t.column("own").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        id, nth, at, n, sample = (t.column(c).to_numpy() for c in ("id", "nth", "at", "n", "sample"))
        row, away = suffixes.shared(own, sample.astype(np.int64), n.astype(np.int64), id - nth, window)
        start = at[row] + sample[row] - away
        return pa.table({"id": pa.array(id[row], pa.int64()), "at": pa.array(start, pa.int64()), "n": pa.array(np.ones(len(row)), pa.int32())})

    return run


def _equal(rows: DataFrame, window: int) -> DataFrame:
    """Groups whose range is one window: rows that a smaller document has, too."""
    rows = rows.select("id", (F.col("id") - F.col("nth")).alias("doc"), F.expr("at + sample - lo").alias("at"), F.expr(f"substring(own, sample - lo + 1, {window})").alias("bytes"))
    least = rows.groupBy("bytes").agg(F.min("doc").alias("least"))
    return rows.join(least, "bytes").filter("doc > least").select("id", "at", F.lit(1).alias("n"))


def shared_runs(blocks: DataFrame, window: int, group: int) -> DataFrame:
    """Runs (id, at, n) of windows that also start in a smaller document: `blocks` has BLOCK's columns, `own` padded to a fixed length; tasks hold about `group` blocks."""
    state = blocks.select("*", F.lit(0).alias("lo"), F.lit(window - suffixes.GRAM).alias("hi"))
    out = None
    while True:
        state = written(state.withColumn("key", F.expr(f"xxhash64(lo, hi, substring(own, sample - lo + 1, {window} - hi + lo))")), "repeats-round")
        large = written(state.groupBy("key").count().filter(F.col("count") > group).select("key"), "repeats-large")
        buckets = max(1, -(-state.count() // group))
        small = state.join(large, "key", "left_anti").withColumn("bucket", F.pmod("key", F.lit(buckets)))
        found = small.groupBy("bucket").applyInArrow(_small(window), RUN)
        out = found if out is None else out.union(found)
        if large.isEmpty():
            return out
        rest = state.join(large, "key", "left_semi")
        out = out.union(_equal(rest.filter("lo = hi"), window))
        wide = rest.filter("lo < hi").withColumn("mid", F.expr("cast((lo + hi) div 2 AS int)"))
        halves = F.expr("inline(array(struct(lo, mid AS hi), struct(mid + 1 AS lo, hi)))")
        wide = wide.select("id", "nth", "at", "n", "sample", "own", halves)
        state = wide.filter("lo <= sample AND hi > sample - n")
