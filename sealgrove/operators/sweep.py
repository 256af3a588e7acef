"""Sweeps over spans: pairs that overlap and spans that nothing covers, in time proportional to the spans and what comes out.

Spark sorts spans by document and start; a task walks along them and holds only those that are still open, so that a document may have any number of spans.

Spans are [s, e). An empty span overlaps what holds its place inside. Spans without a start or an end take no part; a null id is an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from sealgrove.operators.joins import row_key


def document_keys(spans: DataFrame) -> tuple[str, ...]:
    """What names a span's document: its row where it has one, and its id."""
    return tuple(c for c in ("row", "doc_id") if c in spans.columns)


def _walked(spans: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """Spans with a hash of their document, in the order of the walk."""
    own = spans.filter("s is not null and e is not null").select(row_key(*keys).alias("_k"), *keys, *columns).select("_k.*", *keys, *columns)
    return own.repartition("h0", "h1").sortWithinPartitions("h0", "h1", "s", "e", *(c for c in columns if c not in ("s", "e")))


def overlapping(spans: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, id_a, id_b): pairs of a document's spans (keys, id, s, e) that overlap, each once, the smaller id first."""
    keys = keys or document_keys(spans)
    schema = StructType([*(spans.schema[k] for k in keys), StructField("id_a", LongType()), StructField("id_b", LongType())])
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, active = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows, a, b = [], [], []
            for i, (h0, h1, s, e, own) in enumerate(zip(columns[0], columns[1], columns[2 + n], columns[3 + n], columns[4 + n], strict=True)):
                if document != (h0, h1):
                    document, active = (h0, h1), []
                active = [x for x in active if x[1] > s]
                for begin, _, other in active:
                    if begin < e and own != other:
                        rows.append(i)
                        a.append(min(own, other))
                        b.append(max(own, other))
                        if len(a) >= 100_000:
                            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[2 : 2 + n]), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)
                            rows, a, b = [], [], []
                active.append((s, e, own))
            if a:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[2 : 2 + n]), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    return _walked(spans, keys, "s", "e", "id").mapInArrow(run, schema)


def uncovered(findings: DataFrame, spans: DataFrame, ratio: float = 0.5, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Findings that no span of their document covers by more than `ratio` of the shorter of both."""
    keys = keys or document_keys(findings)
    names = [c for c in findings.columns if c not in (*keys, "s", "e")]
    rest = F.struct(*names) if names else F.struct(F.lit(None).cast("string").alias("_"))
    both = findings.select(*keys, "s", "e", F.lit(0).alias("_side"), rest.alias("_rest"))
    both = both.unionByName(spans.select(*keys, "s", "e", F.lit(1).alias("_side"), F.lit(None).cast(both.schema["_rest"].dataType).alias("_rest")))
    schema = StructType([*(both.schema[k] for k in keys), both.schema["s"], both.schema["e"], both.schema["_rest"]])
    arrow, n = to_arrow_schema(schema), len(keys)

    def covers(f: list, s: int, e: int) -> bool:
        shorter = min(f[1] - f[0], e - s)
        return f[0] < e and s < f[1] and (shorter <= 0 or (min(f[1], e) - max(f[0], s)) / shorter > ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, open_, over = None, [], []  # findings not yet covered, with their rows; spans
        for batch in batches:
            out: list[dict] = []
            names = batch.schema.names[2 : 2 + n]
            columns = [c.to_pylist() for c in batch.columns]
            for i, (h0, h1, s, e, side, own) in enumerate(zip(columns[0], columns[1], *columns[2 + n : 6 + n], strict=True)):
                if document != (h0, h1):
                    out += [f[2] for f in open_]
                    document, open_, over = (h0, h1), [], []
                out += [f[2] for f in open_ if f[1] <= s]
                open_ = [f for f in open_ if f[1] > s]
                over = [x for x in over if x[1] > s]
                if side:
                    open_ = [f for f in open_ if not covers(f, s, e)]
                    over.append((s, e))
                elif not any(covers([s, e], *x) for x in over):
                    open_.append([s, e, {**{k: columns[2 + j][i] for j, k in enumerate(names)}, "s": s, "e": e, "_rest": own}])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if open_:
            yield pa.RecordBatch.from_pylist([f[2] for f in open_], schema=arrow)

    left = _walked(both, keys, "s", "e", "_side", "_rest").mapInArrow(run, schema)
    return left.select(*(F.col(f"_rest.{c}") if c in names else F.col(c) for c in findings.columns))


def outermost(spans: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Spans (keys, id, s, e) that no other span of their document contains; of equal spans the one of smallest id. What begins earlier or reaches farther comes first, so that the farthest end before tells."""
    keys = keys or document_keys(spans)
    before = Window.partitionBy(row_key(*keys)).orderBy("s", F.desc("e"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("e").over(before)).filter("_reach is null or _reach < e").drop("_reach")
