"""Joins on keys that may be null, and numbering of rows without one task for a hot key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.sources.tables import written


def row_key(*columns: str) -> Column:
    """128 bits that stand for the values of columns, nulls included: rows have one key if they agree in all of them."""
    values = [x for c in columns for x in (F.isnull(c), F.col(c))]
    return F.struct(*(F.xxhash64(F.lit(k), *values).alias(f"h{k}") for k in (0, 1)))


def identified(df: DataFrame, *texts: str) -> DataFrame:
    """`df` with `row`: what tells its documents apart, whatever their ids. Documents of equal session, id and texts are one; an id may be null, repeat, or recur in another session."""
    return df.withColumn("row", row_key(*(c for c in ("session_id", "doc_id") if c in df.columns), *texts))


def _hashed(a: DataFrame, b: DataFrame, keys: tuple[str, ...] | list[str]) -> bool:
    """Whether equal keys have equal hashes: both sides have them as strings or as integers of one size."""
    kinds = [(a.schema[k].dataType, b.schema[k].dataType) for k in keys]
    return len(keys) > 1 and all(x == y and x.typeName() in ("string", "integer", "long") for x, y in kinds)


def joined(a: DataFrame, b: DataFrame, keys: tuple[str, ...] | list[str], how: str = "inner", large: bool = False) -> DataFrame:
    """`a` joined with `b` on equal keys, null being equal to null; the keys are a's. Other columns must have different names.

    `large`: both sides grow with the documents, so that neither is broadcast. Spark takes the size of compressed files for that of texts made from them, and would pass all texts through the driver.
    Keys of several columns meet by their hash first: rows are then sorted by a number that tells most of them apart, and not by a session that many of them share.
    """
    hashed = _hashed(a, b, keys)
    b = b.select(*(F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in b.columns))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    if hashed:
        same = (F.xxhash64(*keys) == F.xxhash64(*(f"_right_{k}" for k in keys))) & same
    out = a.join(b.hint("merge") if large else b, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_right_{k}" for k in keys))


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str = "n") -> DataFrame:
    """`df` with `name`: 0, 1, ... within equal keys, in the order of the columns `order`.

    Rows are sorted over all tasks by range, so that a key with a third of all rows is cut into many ranges; each task numbers its own
    rows, and what the ranges before it hold of a key is added. Only counts by range and key are summed up by key.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    own = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1
    out = joined(ranged.withColumn("_own", own), offsets, ("_range", *keys))
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
