"""Layered settings: built-in ones of document types with users' overrides upon them, and prompts from the result.

Settings are rows (type_id, path, value): a leaf of a tree of any depth, its names joined by dots. Overrides are rows (user_id, type_id, path, value). They are merged as trees are: a leaf that both have is the
user's, one that only one has stays, and where one has a leaf and the other a branch at the same place, the user's counts. A null value of an override takes the leaf, or the whole branch, away; where there is nothing of its path, it changes nothing. A type that only overrides have is
a type of the user's own.

Edge cases: of several overrides of a user for one path the greatest value counts, null last; a user's branch under an own leaf of the user's is as if the leaf weren't there; paths and ids that are null don't count; a user
without overrides has no rows, as the built-in ones are the user's settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETTINGS = "type_id string, path string, value string"


def above(path: Column) -> Column:
    """All paths that lie above a path: of a.b.c these are a and a.b."""
    names = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "."))


def _strictly_above(path: Column) -> Column:
    return F.filter(above(path), lambda p: p != path)


def layered(built_in: DataFrame, overrides: DataFrame) -> DataFrame:
    """(user_id, type_id, path, value, source): the settings of each user who has overrides, by type; source is `built-in` or `user`.

    Each path meets the paths above it in equal-key joins, so that a merge takes as many rows as there are settings times their depth.
    """
    own = overrides.filter("user_id is not null and type_id is not null and path is not null").groupBy("user_id", "type_id", "path").agg(F.max("value").alias("value"))
    # A leaf of the user's own that has a branch of the user's under it gives way to the branch.
    branches = own.filter("value is not null").select("user_id", "type_id", F.explode(_strictly_above(F.col("path"))).alias("path")).distinct()
    own = own.filter("value is null").unionByName(own.filter("value is not null").join(branches, ["user_id", "type_id", "path"], "left_anti"))
    base = built_in.filter("type_id is not null and path is not null").groupBy("type_id", "path").agg(F.max("value").alias("value"))

    # A built-in leaf gives way to an override at its place or above it, and to a branch of overrides under it. The types that a user has no override for stay whole.
    hit = base.select("type_id", F.col("path").alias("leaf"), F.explode(above(F.col("path"))).alias("path"))
    gone = hit.join(own.select("user_id", "type_id", "path"), ["type_id", "path"]).select("user_id", "type_id", F.col("leaf").alias("path"))
    gone = gone.unionByName(base.select("type_id", "path").join(branches, ["type_id", "path"]).select("user_id", "type_id", "path")).distinct()
    touched = own.select("user_id", "type_id").distinct()
    kept = touched.join(base, "type_id").join(gone, ["user_id", "type_id", "path"], "left_anti").select("user_id", "type_id", "path", "value", F.lit("built-in").alias("source"))
    return kept.unionByName(own.filter("value is not null").select("user_id", "type_id", "path", "value", F.lit("user").alias("source")))


def prompts(settings: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("user_id", "type_id")) -> DataFrame:
    """(keys, prompt) of documents (keys, title, at) of a user and type: the type's preface, its instructions in order of their paths, what its sliders say, and the documents as a list if there are several.

    Paths: `preface`, `instructions.*`, `sliders.*` with 1 to 5, of which 3 says nothing.
    """
    level = F.element_at(F.map_from_arrays(F.array(*map(F.lit, "1245")), F.array(*map(F.lit, ("far less", "less", "more", "far more")))), F.col("value"))
    part = F.when(F.col("path") == "preface", F.struct(F.lit(0).alias("o"), "path", F.col("value").alias("text")))
    part = part.when(F.startswith("path", F.lit("instructions.")), F.struct(F.lit(1).alias("o"), "path", F.concat(F.lit("- "), F.col("value")).alias("text")))
    said = F.concat(F.substring_index("path", ".", -1), F.lit(": "), F.when(F.col("value").isin(*"1245"), level))
    part = part.when(F.startswith("path", F.lit("sliders.")) & said.isNotNull(), F.struct(F.lit(2).alias("o"), "path", said.alias("text")))
    lines = settings.withColumn("_part", part).filter("_part is not null").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["text"]), "\n").alias("_head"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "title"))
    titled = documents.withColumn("_n", nth).withColumn("_line", F.struct("_n", F.concat(F.col("_n").cast("string"), F.lit(". "), F.coalesce("title", F.lit("untitled"))).alias("text")))
    listed = titled.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda p: p["text"]), "\n").alias("_list"), F.count(F.lit(1)).alias("_count"))
    out = listed.join(lines, list(keys), "left")
    return out.select(*keys, F.concat_ws("\n", "_head", F.when(F.col("_count") > 1, F.concat(F.lit("Documents:\n"), F.col("_list")))).alias("prompt"))
