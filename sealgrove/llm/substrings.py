"""Dedup of repeated substrings: induced sorting of sampled suffixes, shard by shard, and by recursion where a shard is too large for a task.

Of external induced sorting it keeps the sample, the names, the reduced problem, the induction with common prefixes and the recursion. Spark's sorts, which spill, stand in for disk-backed priority
queues, no suffix array is written, and most removals are decided by hashes of blocks, without comparing bytes (README).

Removed is each byte covered by a string of `window` bytes that also starts in a document of smaller doc_id. The work follows an
induced suffix sort, in which few suffixes are sorted and the others are induced from them:

1. Sampling: of the suffixes that start in a window, one is sampled by its content (suffixes.blocks); a sample's block holds all the
   windows it stands for. A block's bytes are named by hashes.
2. Naming: the blocks' names are dealt to shards by the sampled gram and sorted there. A block whose name a smaller document has too is
   removed whole. Of the others, only names that share their gram with another name go on: the reduced problem.
3. Induction: these blocks' suffixes are sorted with the lengths of common prefixes, and both are carried to the left byte by
   byte (suffixes.induced), which finds the windows that blocks of different names share.
4. The removed runs meet their documents, which are cut.

Suffix tuples move between the steps through Spark's shuffle, which sorts and spills; a task holds a shard of SHARD_BYTES of text at a time, whatever the input's size. The blocks of one gram stay
together, so a gram in very many documents makes a shard too large: of shards with over PART_BYTES of names these are rows that Spark groups, and the induction recurses (induction.py). Blocks that a
task meets repeatedly are resolved there, so that a passage of a third of all documents costs a shard one tuple for each task.

Edge cases: null text is empty and has no bytes; a null doc_id counts as greater than all others; rows of equal doc_id, null too, never
remove from one another; doc_ids may be any bigint; texts shorter than a window stay whole; empty tables give empty tables. Names have 88 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealgrove.llm import induction, suffixes
from sealgrove.llm.texts import bounded_batches
from sealgrove.operators.joins import joined, numbered
from sealgrove.sources.tables import read_table, written

WINDOW = 50
#: Text that a shard stands for, and text of which a task resolves the repeats before it sends them.
SHARD_BYTES, TASK_BYTES = 2 << 20, 16 << 20
#: Bytes of packed rows that a task hands over at once.
SENT_BYTES = 4 << 20
#: Names of blocks of which one task takes a shard at once (other shards recurse), and blocks that one task induces from then.
PART_BYTES, GROUP = 16 << 20, 1 << 16
#: Columns of what is sent: blocks to name, removed runs of windows, blocks to induce from, and their bytes. A row's id less `nth` is its document's first id.
NAMED = (("gram", "<u4"), ("name", "<u8"), ("id", "<i8"), ("nth", "<i8"), ("at", "<u4"), ("n", "u1"), ("sample", "u1"))
RUNS = (("id", "<i8"), ("at", "<u4"), ("n", "<u4"))
ASKED = (("id", "<i8"), ("nth", "<i8"), ("at", "<u4"), ("n", "u1"), ("sample", "u1"), ("gram", "<u4"), ("shard", "<i4"))
SENT = "kind int, part int, size int, payload binary"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("payload", pa.binary())])


def _pack(columns: tuple, arrays: dict[str, np.ndarray]) -> bytes:
    """Columns one after the other, each by planes of bytes, which compress better."""
    n = len(arrays[columns[0][0]])
    out = [np.array([n], dtype="<i8").tobytes()]
    for name, kind in columns:
        a = np.ascontiguousarray(arrays[name].astype(kind))
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(n, -1).T).tobytes() if n else b"")
    return b"".join(out)


def _unpack(columns: tuple, payloads: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in columns}
    for p in payloads:
        n, at = int(np.frombuffer(p, dtype="<i8", count=1)[0]), 8
        for name, kind in columns:
            size = np.dtype(kind).itemsize
            planes = np.frombuffer(p, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
            parts[name].append(np.ascontiguousarray(planes.T).view(kind).ravel())
            at += n * size
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, dtype=kind) for name, kind in columns}


def _split(columns: tuple, arrays: dict[str, np.ndarray], by: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of each value of `by`, packed."""
    order = np.argsort(by, kind="stable")
    keys, first = np.unique(by[order], return_index=True)
    if not len(by):
        return
    for k, a, b in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), len(by)], strict=True):
        yield k, _pack(columns, {name: arrays[name][order[a:b]] for name, _ in columns})


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part in which a document meets its runs."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _frame(kind: int, rows: Iterator[tuple[int, bytes]]) -> pd.DataFrame:
    rows = list(rows)
    part, size = (np.array(x, dtype=np.int32) for x in ([r[0] for r in rows], [len(r[1]) for r in rows]))
    return pd.DataFrame({"kind": np.full(len(rows), kind, dtype=np.int32), "part": part, "size": size, "payload": [r[1] for r in rows]})


def _batches(kind: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Packed rows as batches of about SENT_BYTES, so that neither side of a worker's pipe holds a whole portion."""
    own: list[tuple[int, bytes]] = []
    held = 0
    for row in rows:
        own.append(row)
        held += len(row[1])
        if held >= SENT_BYTES:
            yield pa.RecordBatch.from_pandas(_frame(kind, iter(own)), schema=_ARROW, preserve_index=False)
            own, held = [], 0
    if own:
        yield pa.RecordBatch.from_pandas(_frame(kind, iter(own)), schema=_ARROW, preserve_index=False)


def _joined(id: np.ndarray, at: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows that follow one another in a document, as one."""
    order = np.lexsort((at, id))
    id, at, n = id[order], at[order].astype(np.int64), n[order].astype(np.int64)
    new = np.ones(len(id), dtype=bool)
    new[1:] = (id[1:] != id[:-1]) | (at[1:] != at[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return {"id": id[first], "at": at[first], "n": np.add.reduceat(n, first) if len(first) else n}


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, what they are beyond their document's first, and texts of a task, in portions of about `size` bytes."""
    ids: list[int] = []
    nths: list[int] = []
    texts: list[bytes] = []
    total = 0
    for batch in batches:
        for i, n, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            ids.append(i)
            nths.append(n)
            texts.append((t or "").encode())
            total += len(texts[-1])
            if total >= size:
                yield np.array(ids, dtype=np.int64), np.array(nths, dtype=np.int64), texts
                ids, nths, texts, total = [], [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(nths, dtype=np.int64), texts


def _sampler(window: int, shards: int):
    """Step 1: names of blocks to their shards, and runs that the task can tell by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nths, texts in _texts(batches, TASK_BYTES):
            order = np.argsort(ids, kind="stable")
            raw = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
            ends = np.cumsum([len(texts[i]) for i in order])
            which, at, n, sample, gram, name = suffixes.blocks(raw, ends, window)
            id, nth = ids[order][which], nths[order][which]
            doc = id - nth
            by = np.lexsort((id, name, gram))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (gram[by][1:] != gram[by][:-1]) | (name[by][1:] != name[by][:-1])
            least = doc[by][np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else doc
            late = np.zeros(len(by), dtype=bool)
            late[by] = doc[by] > least
            send = ~late
            shard = (gram >> np.uint64(32)) % np.uint64(shards)
            arrays = {"gram": gram & np.uint64(0xFFFFFFFF), "name": name, "id": id, "nth": nth, "at": at, "n": n, "sample": sample}
            if late.any():
                runs = _joined(id[late], at[late], n[late])
                yield from _batches(1, _split(RUNS, runs, _part(runs["id"], shards)))
            arrays, shard = {k: v[send] for k, v in arrays.items()}, shard[send].astype(np.int64)
            del raw, texts, which, at, n, sample, gram, name, id, nth, doc, by, new, least, late, send
            yield from _batches(0, _split(NAMED, arrays, shard))

    return run


def _namer(shards: int):
    """Step 2: runs of blocks whose name a smaller document has, and blocks of names that share a gram."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["part"].iloc[0])
        out = [frame[frame["kind"] == 1]]
        b = _unpack(NAMED, list(frame.loc[frame["kind"] == 0, "payload"]))
        if len(b["id"]):
            order = np.lexsort((b["id"], b["name"], b["gram"]))
            b = {k: v[order] for k, v in b.items()}
            new_gram = np.ones(len(order), dtype=bool)
            new_gram[1:] = b["gram"][1:] != b["gram"][:-1]
            new = new_gram.copy()
            new[1:] |= b["name"][1:] != b["name"][:-1]
            doc = b["id"] - b["nth"]
            late = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            runs = _joined(*(b[k][late] for k in ("id", "at", "n")))
            out.append(_frame(1, _split(RUNS, runs, _part(runs["id"], shards))))
            of = np.cumsum(new_gram) - 1
            shared = (np.bincount(of[new], minlength=of[-1] + 1) > 1)[of] & ~late
            asked = {k: v[shared] for k, v in b.items()} | {"shard": np.full(int(shared.sum()), shard)}
            out.append(_frame(2, _split(ASKED, asked, _part(asked["id"], shards))))
        return pd.concat(out)

    return run


def _packed_texts(shards: int):
    """Documents by part, compressed: (part, ids, sizes, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for ids, _, texts in _texts(batches, TASK_BYTES):
            part = _part(ids, shards)
            order = np.argsort(part, kind="stable")
            keys, first = np.unique(part[order], return_index=True)
            rows = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                own = order[a:b]
                sizes = np.array([len(texts[i]) for i in own], dtype="<i8")
                rows.append((ids[own].astype("<i8").tobytes(), sizes.tobytes(), pack.compress(b"".join(texts[i] for i in own))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["part", "ids", "sizes", "texts"])

    return run


def _open(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, begins (one more than ids) and the texts of a part, in order of ids."""
    unpack = zstandard.ZstdDecompressor()
    ids = np.concatenate([np.frombuffer(x, dtype="<i8") for x in frame["ids"]])
    sizes = np.concatenate([np.frombuffer(x, dtype="<i8") for x in frame["sizes"]])
    text = b"".join(unpack.decompress(x, max_output_size=int(np.frombuffer(s, dtype="<i8").sum()) or 1) for x, s in zip(frame["texts"], frame["sizes"], strict=True))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(ids, kind="stable")
    return ids[order], np.stack([begin[:-1][order], sizes[order]], axis=1), text


def _context(window: int):
    """Step 3a: the bytes of the blocks to induce from, to the shard of their gram: (id, at, sample, n, bytes)."""

    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(asked):
            return _frame(3, iter(()))
        ids, place, text = _open(docs)
        raw = np.frombuffer(text, dtype=np.uint8)
        b = _unpack(ASKED, list(asked["payload"]))
        begin = place[np.searchsorted(ids, b["id"]), 0] + b["at"]
        wide = 2 * window
        at = np.minimum(begin[:, None] + np.arange(wide)[None, :], len(raw) - 1)
        size = b["n"].astype(np.int64) + window - 1
        own = np.where(np.arange(wide)[None, :] < size[:, None], raw[at], 0)
        columns = _context_columns(window)
        arrays = {k: b[k] for k in ("id", "nth", "at", "n", "sample")} | {f"c{i}": own[:, i] for i in range(wide)}
        return _frame(3, _split(columns, arrays, b["shard"].astype(np.int64)))

    return run


def _context_columns(window: int) -> tuple:
    return (("id", "<i8"), ("nth", "<i8"), ("at", "<u4"), ("n", "u1"), ("sample", "u1"), *((f"c{i}", "u1") for i in range(2 * window)))


def _inducer(window: int, shards: int):
    """Step 3b: runs of windows that blocks of different names share with a smaller document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = _unpack(_context_columns(window), list(frame["payload"]))
        own = np.stack([b[f"c{i}"] for i in range(2 * window)], axis=1)
        sample = b["sample"].astype(np.int64)
        row, away = suffixes.shared(own, sample, b["n"].astype(np.int64), b["id"] - b["nth"], window)
        runs = _joined(b["id"][row], b["at"][row].astype(np.int64) + sample[row] - away, np.ones(len(row), dtype=np.int64))
        return _frame(1, _split(RUNS, runs, _part(runs["id"], shards)))

    return run


NAME = "part int, gram long, name long, id long, nth long, at long, n int, sample int"


def _named_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed names of large shards as rows."""
    for batch in batches:
        for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            b = _unpack(NAMED, [payload])
            n = len(b["id"])
            columns = [np.full(n, part), b["gram"], b["name"].view(np.int64), b["id"], b["nth"], b["at"], b["n"], b["sample"]]
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], names=["part", "gram", "name", "id", "nth", "at", "n", "sample"])


def _block_rows(window: int):
    """Packed blocks of large shards as rows, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                b = _unpack(_context_columns(window), [payload])
                own = np.stack([b[f"c{i}"] for i in range(2 * window)], axis=1)
                columns = [pa.array(b[k].astype(np.int64)) for k in ("id", "nth", "at")] + [pa.array(b[k].astype(np.int32)) for k in ("n", "sample")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in own], pa.binary())], names=["id", "nth", "at", "n", "sample", "own"])

    return run


def _packed_rows(kind: int, columns: tuple, shards: int):
    """Rows packed by their documents' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = {name: batch.column(name).to_numpy() for name, _ in columns}
            if len(arrays["id"]):
                yield from _batches(kind, _split(columns, arrays, _part(arrays["id"], shards)))

    return run


def _large_names(named: DataFrame, shards: int) -> DataFrame:
    """Step 2 for shards too large for a task, as rows: removed runs, and blocks of names that share a gram, whose shards go on as negative numbers."""
    rows = named.mapInArrow(_named_rows, NAME)
    least = rows.groupBy("part", "gram", "name").agg(F.min(F.col("id") - F.col("nth")).alias("least"))
    rows = rows.join(least, ["part", "gram", "name"])
    late = rows.filter("id - nth > least").select("id", "at", "n").mapInArrow(_packed_rows(1, RUNS, shards), SENT)
    several = least.groupBy("part", "gram").count().filter("count > 1").select("part", "gram")
    asked = rows.filter("id - nth = least").join(several, ["part", "gram"], "left_semi").withColumn("shard", -1 - F.col("part"))
    asked = asked.select("id", "nth", "at", "n", "sample", "gram", "shard").mapInArrow(_packed_rows(2, ASKED, shards), SENT)
    return late.union(asked)


CUT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def _cutter(window: int):
    """Step 4: each document of a part with its removed spans and what is left."""

    def run(docs: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept", "spans")}
        if len(docs):
            ids, place, text = _open(docs)
            r = _unpack(RUNS, list(runs["payload"]))
            order = np.lexsort((r["at"], r["id"]))
            id, start = r["id"][order], r["at"][order].astype(np.int64)
            end = start + r["n"][order].astype(np.int64) + window - 1
            lo, hi = np.searchsorted(id, ids, side="left"), np.searchsorted(id, ids, side="right")
            for i, (begin, size) in enumerate(place.tolist()):
                own, spans = text[begin : begin + size], []
                if hi[i] > lo[i]:
                    s, e = start[lo[i] : hi[i]], np.maximum.accumulate(end[lo[i] : hi[i]])
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    spans = list(zip(s[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist(), strict=True))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(own[at:a])
                    at = b
                kept.append(own[at:])
                values = (ids[i], size, sum(b - a for a, b in spans), len(spans), b"".join(kept), [{"start": a, "end": b} for a, b in spans])
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
        return pd.DataFrame(out)

    return run


def drop_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, group: int = GROUP) -> DataFrame:
    """A row for each row of `df`: doc_id, n_bytes, n_removed, n_spans, `kept` (the bytes that are left) and the removed spans.

    Shards with more than `part_bytes` of names recurse, with about `group` blocks in a task; both bound memory and change no result.
    """
    if not suffixes.GRAM < window < 128:
        raise ValueError(f"windows of {suffixes.GRAM + 1} to 127 bytes are sorted")
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.lit(0).cast("long").alias("nth"), F.col(text).alias("text"))
    total, rows, ids = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.countDistinct("id")).first()
    total = total or 0
    own = None
    if rows > ids:  # rows of equal doc_id, or without one: all rows are numbered in order of doc_ids, and a document's rows follow its first
        own = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_id).isNull().alias("none"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
        own = written(numbered(own, (), ("none", "doc", "hash"), "id"), "repeats-numbered")
        firsts = own.groupBy("doc").agg(F.min("id").alias("first"))
        docs = joined(own, firsts, ("doc",)).select("id", (F.col("id") - F.col("first")).alias("nth"), "text")
    shards = max(16, -(-total // SHARD_BYTES))

    names = F.sum(F.when(F.col("kind") == 0, F.col("size"))).over(Window.partitionBy("part"))
    named = docs.mapInArrow(_sampler(window, shards), SENT).withColumn("names", F.coalesce(names, F.lit(0)))
    found = named.filter((F.col("names") <= part_bytes) | (F.col("kind") == 1)).drop("names").groupBy("part").applyInPandas(_namer(shards), SENT)
    large = named.filter((F.col("names") > part_bytes) & (F.col("kind") == 0)).withColumn("kind", F.lit(4))
    found = written(found.union(large.select(found.columns)), "repeats-found")
    some = not found.filter("kind = 4").isEmpty()
    if some:
        found = found.union(written(_large_names(found.filter("kind = 4"), shards), "repeats-large"))
    runs, asked = found.filter("kind = 1"), found.filter("kind = 2")
    parts = docs.mapInArrow(_packed_texts(shards), "part int, ids binary, sizes binary, texts binary")
    near = parts.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(_context(window), SENT)
    if some:
        near = written(near, "repeats-near")
        blocks = near.filter("part < 0").mapInArrow(_block_rows(window), induction.BLOCK)
        runs = runs.union(induction.shared_runs(blocks, window, group).mapInArrow(_packed_rows(1, RUNS, shards), SENT))
        near = near.filter("part >= 0")
    runs = runs.union(near.groupBy("part").applyInPandas(_inducer(window, shards), SENT))
    out = parts.groupBy("part").cogroup(runs.groupBy("part")).applyInPandas(_cutter(window), CUT)
    if own is not None:
        return out.join(own.select("id", F.col("doc").alias(doc_id)), "id").select(doc_id, "n_bytes", "n_removed", "n_spans", "kept", "spans")
    return out.withColumnRenamed("id", doc_id)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_substrings": op5_substrings}
ORACLES: dict[str, str] = {}
