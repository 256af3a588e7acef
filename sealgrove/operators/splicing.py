"""Spans of texts replaced in an Arrow pass: texts and spans are sorted together by document, so that neither arrays of spans nor a join stand between."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sealgrove.operators.plain import _buffers, _cut

#: Bytes of texts and of what is put into them that are put together at once.
AT_ONCE = 1 << 22


def _put(texts: pa.StringArray, count: np.ndarray, s: np.ndarray, e: np.ndarray, shown: pa.StringArray) -> pa.StringArray:
    """Texts with their spans replaced; the first `count[0]` spans, places of characters, are the first text's, and so on."""
    offsets, data = _buffers(texts)
    offsets = offsets.astype(np.int64)
    own, n = np.repeat(np.arange(len(texts)), count), len(s)
    if (data < 128).all():
        at = lambda x: np.minimum(offsets[own] + x, offsets[own + 1])
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars, lead = np.searchsorted(lead, offsets), np.append(lead, len(data))
        at = lambda x: lead[np.minimum(chars[own] + x, chars[own + 1])]
    begins, ends = at(s), at(e)
    into, more = _buffers(shown)
    # Pieces of a text: what stands before its first span, what is shown for that, and so on, and what stands behind the last.
    first = np.concatenate(([0], np.cumsum(2 * count + 1)))
    before = 2 * np.arange(n) + own
    begin, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    begin[first[:-1]], end[first[1:] - 1] = offsets[:-1], offsets[1:]
    begin[before + 2], end[before] = ends, begins
    begin[before + 1], end[before + 1] = len(data) + into[:-1], len(data) + into[1:]
    pieces, out = _buffers(_cut(np.concatenate((data, more)), begin, end))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(pieces[first].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))


def _spans(batch: pa.RecordBatch, group: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Groups, starts, ends and texts of the spans at some places, each once."""
    s, e = (batch.column(k).take(pa.array(where)).to_numpy() for k in (3, 4))
    shown = batch.column(5).take(pa.array(where)).cast(pa.string()).fill_null("")
    group, number = group[where], shown.dictionary_encode().indices.to_numpy()
    new = np.ones(len(where), bool)
    new[1:] = (group[1:] != group[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (number[1:] != number[:-1])
    return group[new], s[new].astype(np.int64), e[new].astype(np.int64), shown.take(pa.array(np.flatnonzero(new)))


def _spliced(batch: pa.RecordBatch, group: np.ndarray, is_text: np.ndarray, at: int) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """Places of texts in a batch whose rows are sorted, spans before texts, and the texts with their spans replaced."""
    docs = np.flatnonzero(is_text)
    own, s, e, shown = _spans(batch, group, np.flatnonzero(~is_text))
    low, high = np.searchsorted(own, group[docs], "left"), np.searchsorted(own, group[docs], "right")
    cut = np.flatnonzero((own[1:] == own[:-1]) & (s[1:] < e[:-1]))
    if len(np.intersect1d(own[cut], group[docs])):
        raise ValueError("spans overlap")
    texts = batch.column(at).take(pa.array(docs)).cast(pa.string())
    sizes = np.diff(_buffers(texts.fill_null(""))[0]).astype(np.int64)
    into = np.concatenate(([0], np.cumsum(np.diff(_buffers(shown)[0]).astype(np.int64))))
    total = sizes + into[high] - into[low]
    part = (np.cumsum(total) - total) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(docs)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        count = high[a:b] - low[a:b]
        mine = np.repeat(low[a:b] - np.cumsum(count) + count, count) + np.arange(count.sum())
        own_texts = texts.slice(a, b - a)
        done = _put(own_texts.fill_null(""), count, s[mine], e[mine], shown.take(pa.array(mine)))
        if own_texts.null_count:
            done = done.take(pa.array(np.arange(b - a), mask=own_texts.is_null().to_numpy(zero_copy_only=False)))
        yield pa.array(docs[a:b]), done


def spliced(docs: DataFrame, spans: DataFrame, text: str, name: str, shown: str) -> DataFrame:
    """`docs` (with `row`, which goes) with `name`: the text with each of the spans (row, s, e and `shown`) of its row replaced. A span counts once; those of a text that overlap are an error.

    Rows of texts and of spans are dealt by document and sorted, spans first; a task holds a batch of them, and the spans of the last document, which more copies may follow.
    """
    kept = [c for c in docs.columns if c != "row"]
    fields = [StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(kept)]
    key = [F.col("row.h0").alias("_h0"), F.col("row.h1").alias("_h1")]
    place = [F.col("s").cast("int").alias("_s"), F.col("e").cast("int").alias("_e"), F.col(shown).alias("_shown")]
    none = [F.lit(None).cast(t).alias(c) for t, c in (("int", "_s"), ("int", "_e"), ("string", "_shown"))]
    texts = docs.select(*key, F.lit(True).alias("_is"), *none, *(F.col(f"`{c}`").alias(f.name) for c, f in zip(kept, fields, strict=True)))
    every = spans.select(*key, F.lit(False).alias("_is"), *place, *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields)).unionByName(texts)
    every = every.repartition("_h0", "_h1").sortWithinPartitions("_h0", "_h1", "_is", "_s", "_e", "_shown")
    at, first = 6 + kept.index(text), 6
    names = [*(f.name for f in fields), "new"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if before is not None and before.num_rows:
                batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
            h0, h1 = (batch.column(k).to_numpy() for k in (0, 1))
            is_text = batch.column(2).to_numpy(zero_copy_only=False)
            group = np.concatenate(([0], np.cumsum((h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1]))))
            for where, done in _spliced(batch, group, is_text, at):
                yield pa.RecordBatch.from_arrays([*(c.take(where) for c in batch.columns[first:]), done], names=names)
            before = batch.take(pa.array(np.flatnonzero((group == group[-1]) & ~is_text)))

    out = every.mapInArrow(run, StructType([*fields, StructField("new", StringType())]))
    columns = [F.col("new" if c == name else f.name).alias(c) for c, f in zip(kept, fields, strict=True)]
    return out.select(*columns, *([] if name in kept else [F.col("new").alias(name)]))
