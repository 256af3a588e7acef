"""Connected components by alternating large and small stars; each round is two aggregations and joins over the edges.

Edge cases: an edge that occurs twice counts once; edges from a node to itself, or with a null end, don't count, so a node that has only those has no row; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrove.sources.tables import remove, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is joined to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them. Edges go from the greater to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge, the component being its smallest node."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v"), "edges")
    state = _state(now)
    while state[0]:
        after = written(_small_star(_large_star(now)), "edges")
        new = _state(after)
        remove(spark, now)
        now = after
        if new == state:
            break
        state = new
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component")).distinct()
