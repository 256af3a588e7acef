"""What several operators share: sizes in words, folds by doc_id, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for a third of all documents, which nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_batches(spark: SparkSession, rows: int = 1000, nbytes: int = 8 << 20) -> None:
    """Arrow batches of at most `rows` rows and about `nbytes` bytes from here on, so that a worker's memory has a bound.

    The session keeps the setting, as plans take it up when they run, which may be long after; smaller settings of its own stay.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", nbytes)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` but for those of the names, which an operator's own columns replace."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it new to `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` as the one column _row, beside an operator's own columns: whatever names df has, none clashes."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(c.alias(name) for name, c in columns.items()))


def unpacked(df: DataFrame, names: list[str]) -> list[Column]:
    """The carried columns of the names again."""
    return [F.col("_row").getField(c).alias(c) for c in names]


def pieces(batch: pa.RecordBatch, at: int, nbytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose values of column `at` have about `nbytes` bytes together, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(float))).astype(np.int64)
    first = 0
    while first < batch.num_rows:
        before = int(size[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(size, before + nbytes, side="right")))
        yield batch.slice(first, end - first)
        first = end


def appended(df: DataFrame, fields: list[StructField], f: Callable[[list], list[list]], column: str, done: Callable[[], None] = lambda: None) -> DataFrame:
    """`df` with columns that `f` gives for the values of a text or binary column, in pieces of a megabyte; existing columns of their names are replaced. `done` runs after each task."""
    bounded_batches(df.sparkSession)
    keep = others(df, *(x.name for x in fields))
    at, rest = df.columns.index(column), [df.columns.index(c) for c in keep]
    schema = StructType([*(df.schema.fields[i] for i in rest), *fields])
    arrow = [to_arrow_type(x.dataType) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                new = [pa.array(v, t) for v, t in zip(f(part.column(at).to_pylist()), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *new], names=schema.names)
        done()
        pa.default_memory_pool().release_unused()  # the worker outlives the task

    return df.mapInArrow(run, schema)
