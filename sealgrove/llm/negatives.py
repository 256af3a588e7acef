"""Hard negatives by product quantisation with stored residual norms.

Vectors become integers, floor(scale * x). A codebook holds 256 integer centroids for each pair of dimensions, fitted on a bounded sample; every vector is
stored as its codes, the norms of what the codes leave out (one for each of GROUPS runs of dimensions, rounded up) and itself. An anchor's lookup tables give
its product with all coded vectors, and the sum of the products of norms bounds how far the true score can be away (Cauchy-Schwarz):

* positives: the k-th highest lower bound of the anchor's label is a floor; who can't reach it is out, the rest is scored exactly;
* negatives: each (anchor, positive) has a window of scores. The k-th highest lower bound among rows that are surely within is a floor; rows that can be
  within the window and above the floor are scored exactly, which completes the window.

The bounds hold for every row, so results are exact whatever the sample; the sample decides only how many rows are scored exactly. Blocks of anchors meet blocks of
candidates in a grid: a task holds up to ANCHOR_ROWS anchors and CANDIDATE_ROWS candidates, and vectors are copied once for each column or row of the grid.

Edge cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part; shorter vectors count as filled up with zeros;
rows of an equal id are candidates each, and an anchor leaves out all rows of its own id; of several rows with an anchor's id the one of smallest label, then vector, asks.
Ties go to the smaller id. A negative positive score has an empty window. Scores must fit 63 bits. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealgrove.sources.tables import read_table, written

#: Rows of the sample that codebooks are fitted on, the only ones that reach the driver; dimensions of a code; centroids; rounds of fitting; runs of dimensions with a norm.
SAMPLE, WIDTH, CENTROIDS, ROUNDS, GROUPS = 4096, 2, 256, 6, 8
#: Rows of a stored block, of which a file's writer and reader hold a hundred at once; rows that are worth a task, and how many one holds of each side, in round numbers; rows that are scored at once.
BLOCK, LEAST, ANCHOR_ROWS, CANDIDATE_ROWS, TILE = 1024, 8192, 16_384, 131_072, (256, 4096)
#: Scored pairs that a task holds before it keeps the first ones of each anchor.
MOST_PAIRS = 1 << 20
PACKED = "block long, ids binary, labels binary, vectors binary, kind string, codes binary, norms binary"


def labelled(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, each component x as floor(scale * x)."""
    x = F.col(embedding)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    out = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return out.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Codebook:
    """Integer centroids of each run of WIDTH dimensions."""

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        rng = np.random.default_rng(7)
        self.centroids = [self._fit(sample[:, at : at + WIDTH].astype(np.float64), rng) for at in range(0, self.dim, WIDTH)]
        self.group = np.arange(self.dim) * GROUPS // self.dim

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c**2).sum(axis=1)[None] - 2 * (x @ c.T), axis=1)

    def _fit(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        c = x[rng.integers(0, len(x), CENTROIDS)]
        for _ in range(ROUNDS):
            own = self._nearest(x, c)
            n = np.bincount(own, minlength=CENTROIDS)
            total = np.stack([np.bincount(own, weights=x[:, d], minlength=CENTROIDS) for d in range(x.shape[1])], axis=1)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        return np.rint(c)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows, and the norms of what they leave out, rounded up."""
        codes = np.empty((len(rows), len(self.centroids)), dtype=np.uint8)
        left = rows.astype(np.float64)
        for m, c in enumerate(self.centroids):
            part = left[:, m * WIDTH : (m + 1) * WIDTH]
            codes[:, m] = self._nearest(part, c)
            part -= c[codes[:, m]]
        return codes, np.nextafter(self.norms(left).astype(np.float32), np.float32(np.inf))

    def norms(self, rows: np.ndarray) -> np.ndarray:
        """Norms of each run of dimensions."""
        return np.stack([np.sqrt((rows[:, self.group == g].astype(np.float64) ** 2).sum(axis=1)) for g in range(GROUPS)], axis=1)

    def tables(self, anchors: np.ndarray, kind: type) -> list[np.ndarray]:
        """For each run, the products of all centroids with the anchors."""
        return [(c @ anchors[:, m * WIDTH : (m + 1) * WIDTH].T.astype(np.float64)).astype(kind) for m, c in enumerate(self.centroids)]


def fitted(rows: DataFrame, sample: int = SAMPLE) -> Codebook | None:
    """A codebook from the `sample` rows of smallest hash; none if there are no rows."""
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return None
    picked = rows.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    return Codebook(_matrix(picked.column("v").combine_chunks(), max(1, dim)))


def packed(rows: DataFrame, book: Codebook, size: int = BLOCK) -> DataFrame:
    """Rows (id, label, v) in blocks, as PACKED."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            ids, labels, m = (np.concatenate(x) for x in zip(*held, strict=True))
            codes, norms = shared.value.encode(m)
            small = next(t for t in (np.int16, np.int32, np.int64) if m.min(initial=0) >= np.iinfo(t).min and m.max(initial=0) <= np.iinfo(t).max)
            own = [number, ids.tobytes(), labels.tobytes(), m.astype(small).tobytes(), np.dtype(small).name, codes.tobytes(), norms.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in PACKED.split(", ")], own, strict=True))])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(pa.concat_arrays([part.column(2)]), shared.value.dim)))
                n += part.num_rows
                if n >= size:
                    yield block()
                    number, held, n = number + 1, [], 0
        if held:
            yield block()

    return rows.select("id", "label", "v").mapInArrow(run, PACKED)


def _unpacked(blocks: pd.DataFrame, dim: int) -> tuple[np.ndarray, ...]:
    """ids, labels, vectors, codes and norms of all rows of some blocks."""
    parts = [
        (np.frombuffer(b.ids, np.int64), np.frombuffer(b.labels, np.int64), np.frombuffer(b.vectors, b.kind).reshape(-1, dim),
         np.frombuffer(b.codes, np.uint8).reshape(len(b.ids) // 8, -1), np.frombuffer(b.norms, np.float32).reshape(-1, GROUPS))
        for b in blocks.itertuples()
    ]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Bounds:
    """Bounds of all scores between a task's anchors and candidates, a tile at a time, and exact scores of chosen pairs."""

    def __init__(self, book: Codebook, anchors: tuple, candidates: tuple):
        self.book, (self.qid, self.qlabel, self.a, _, _), (self.cid, self.clabel, self.c, self.codes, self.norms) = book, anchors, candidates
        self.a_norms = book.norms(self.a) * (1 + 1e-12)
        whole = np.sqrt((self.c.astype(np.float64) ** 2).sum(axis=1)) + self.norms.sum(axis=1)  # no less than any coded row's norm
        reach = np.sqrt((self.a.astype(np.float64) ** 2).sum(axis=1)) * (2 * whole.max(initial=0) + 1)
        self.kind = np.float32 if reach.max(initial=0) < 2**24 else np.float64  # sums of integers are exact
        self.slack = 1 + 1e-6 * reach

    def tiles(self) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
        """(anchors, candidates, lower, upper): bounds as (candidate, anchor)."""
        for i in range(0, len(self.qid), TILE[0]):
            qs = slice(i, i + TILE[0])
            tables, limit = self.book.tables(self.a[qs], self.kind), self.a_norms[qs].T
            for j in range(0, len(self.cid), TILE[1]):
                cs = slice(j, j + TILE[1])
                codes = self.codes[cs]
                near = np.zeros((len(codes), len(self.qid[qs])), dtype=self.kind)
                for m, t in enumerate(tables):
                    near += t.take(codes[:, m], axis=0)
                away = (self.norms[cs].astype(np.float64) @ limit + self.slack[qs]).astype(self.kind)
                yield qs, cs, near - away, near + away

    def exact(self, qs: slice, cs: slice, c: np.ndarray, q: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """Scores of pairs of a tile's rows."""
        out = np.empty(len(c), dtype=np.int64)
        for k in range(0, len(c), at_once):
            part = slice(k, k + at_once)
            out[part] = np.einsum("ij,ij->i", self.c[cs][c[part]].astype(np.int64), self.a[qs][q[part]].astype(np.int64))
        return out


def _floor(best: np.ndarray, lower: np.ndarray, k: int) -> np.ndarray:
    """The k highest values so far of each column, given those of before; the first row is the floor."""
    both = np.concatenate([best, lower])
    return np.partition(both, len(both) - k, axis=0)[-k:]


def _first(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each q's k first: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, q))
    run = q[order]
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    nth = np.arange(len(run)) - np.repeat(begin, np.diff(np.append(begin, len(run))))
    return order[nth < k]


class Firsts:
    """The k first pairs (number, id, score) of each number among all that are added: the others are dropped whenever some MOST_PAIRS are held."""

    def __init__(self, k: int):
        self.k, self.held, self.n = k, [(np.zeros(0, np.int64),) * 3], 0

    def add(self, number: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.held.append((number, ids, scores))
        self.n += len(ids)
        if self.n > MOST_PAIRS:
            self.first()
            self.n = 0

    def first(self) -> tuple[np.ndarray, ...]:
        number, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        kept = _first(number, ids, scores, self.k)
        self.held = [(number[kept], ids[kept], scores[kept])]
        return self.held[0]


def _positives(book: Codebook, k: int):
    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"qid": [], "id": [], "score": []}).astype(np.int64)
        b = Bounds(book, _unpacked(qs, book.dim), _unpacked(cs, book.dim))
        best = np.full((k, len(b.qid)), -np.inf)
        found = Firsts(k)
        for q, c, lower, upper in b.tiles():
            same = (b.clabel[c][:, None] == b.qlabel[q][None]) & (b.cid[c][:, None] != b.qid[q][None])
            best[:, q] = _floor(best[:, q], np.where(same, lower, -np.inf), k)
            rows, at = np.nonzero(same & (upper >= best[:, q].min(axis=0)))
            found.add(at + q.start, b.cid[c][rows], b.exact(q, c, rows, at))
        at, ids, scores = found.first()
        return pd.DataFrame({"qid": b.qid[at], "id": ids, "score": scores})

    return run


def _negatives(book: Codebook, k: int, slots: int):
    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"qid": [], "slot": [], "id": [], "score": []}).astype(np.int64)
        b = Bounds(book, _unpacked(qs, book.dim), _unpacked(cs, book.dim))
        lo, hi = (np.concatenate([np.frombuffer(x, np.int64).reshape(-1, slots) for x in qs[name]]) for name in ("lo", "hi"))
        best = np.full((slots, k, len(b.qid)), -np.inf)
        found = Firsts(k)
        for q, c, lower, upper in b.tiles():
            other = b.clabel[c][:, None] != b.qlabel[q][None]
            other &= b.cid[c][:, None] != b.qid[q][None]
            asked = np.zeros_like(other)
            for s in range(slots):
                low, high = lo[q, s], hi[q, s]
                if (low > high).all():
                    continue
                sure = other & (lower >= low) & (upper <= high)
                best[s][:, q] = _floor(best[s][:, q], np.where(sure, lower, -np.inf), k)
                asked |= other & (upper >= np.maximum(best[s][:, q].min(axis=0), low)) & (lower <= high)
            rows, at = np.nonzero(asked)
            scores = b.exact(q, c, rows, at)
            at, ids = at + q.start, b.cid[c][rows]
            for s in range(slots):
                within = (scores >= lo[at, s]) & (scores <= hi[at, s])
                found.add(at[within] * slots + s, ids[within], scores[within])
        at, ids, scores = found.first()
        return pd.DataFrame({"qid": b.qid[at // slots], "slot": at % slots, "id": ids, "score": scores})

    return run


def _grid(left: DataFrame, n_left: int, right: DataFrame, n_right: int):
    """Blocks of both sides cogrouped so that every two meet once: each is dealt to a row or column of the grid and copied along it."""

    def dealt(blocks: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return blocks.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")))

    return dealt(left, "_a", n_left, "_c", n_right).groupBy("_a", "_c").cogroup(dealt(right, "_c", n_right, "_a", n_left).groupBy("_a", "_c"))


def _ranked(found: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The k first of each key over all tasks, with `rank`."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, book: Codebook | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (id, label, v) tables of integer vectors.

    An anchor's positives are the rows of its label with the highest scores. For each of them the negatives are the highest-scoring rows of other labels whose
    score lies between a half and 95 hundredths of the positive's.
    """
    spark = rows.sparkSession
    book = book or fitted(rows)
    if book is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cands = written(packed(rows, book), "negatives-candidates")
    anchors = anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    anchors = written(anchors, "negatives-anchors")
    n_anchors, n_cands = anchors.count(), cands.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    tasks = spark.sparkContext.defaultParallelism
    n_a, n_c = -(-n_anchors // ANCHOR_ROWS) or 1, max(-(-int(n_cands) // CANDIDATE_ROWS), min(2 * tasks, -(-int(n_cands) // LEAST))) or 1
    asked = packed(anchors.repartition(n_a, "id"), book)
    positives = _grid(asked, n_a, cands, n_c).applyInPandas(_positives(book, n_positives), "qid long, id long, score long")
    positives = written(_ranked(positives, ("qid",), n_positives), "negatives-positives")

    # Windows of each anchor, one a positive; one that is missing ends before it begins.
    windows = positives.filter("score >= 0").withColumns({"lo": F.expr("score div 2 + score % 2"), "hi": F.expr("score div 20 * 19 + score % 20 * 19 div 20")}).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))
    windowed = anchors.join(windows.withColumnRenamed("qid", "id"), "id")
    shared = spark.sparkContext.broadcast(book)

    def with_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            m = _matrix(pa.concat_arrays([batch.column(2)]), shared.value.dim)
            lo, hi = np.ones((len(m), n_positives), np.int64), np.zeros((len(m), n_positives), np.int64)
            for i, w in enumerate(batch.column(3).to_pylist()):
                for x in w:
                    lo[i, x["rank"] - 1], hi[i, x["rank"] - 1] = x["lo"], x["hi"]
            codes, norms = shared.value.encode(m)
            ids, labels = (batch.column(k).to_numpy().tobytes() for k in (0, 1))
            own = {"block": number, "ids": ids, "labels": labels, "vectors": m.tobytes(), "kind": "int64", "codes": codes.tobytes(), "norms": norms.tobytes(), "lo": lo.tobytes(), "hi": hi.tobytes()}
            yield pa.RecordBatch.from_pylist([own])
            number += 1

    asked = windowed.select("id", "label", "v", "w").repartition(n_a, "id").mapInArrow(with_windows, PACKED + ", lo binary, hi binary")
    found = _grid(asked, n_a, cands, n_c).applyInPandas(_negatives(book, n_negatives, n_positives), "qid long, slot long, id long, score long")
    found = _ranked(found, ("qid", "slot"), n_negatives)
    own = positives.select("qid", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(own, ["qid", "slot"]).select(
        F.col("qid").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(read_table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.filter(F.col("id") % 50 == 0))


SQL = """
with rows as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select a.id as anchor_id, b.id, a.label = b.label as same, coalesce(list_dot_product(a.v, b.v), 0)::bigint as score
  from rows a join rows b on a.id <> b.id where a.id % 50 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""

QUERIES = {"op11_negatives": op11_negatives}
ORACLES = {"op11_negatives": SQL}
