"""Quality classifier by Bradley-Terry pairwise ranking.

Each labelled document of quality 1 is preferred to those of quality 0. From preference pairs, the weights of a linear score are
learned by logistic loss on the pairs' feature differences; a difference of scores is then the log-odds of being preferred. The
threshold is the quantile of the labelled documents' scores that lets pass as many as are labelled 1, and a document's final score
is the probability that it is preferred to one at the threshold.

Features are computed from whole texts, in one pass over all documents. The model is fitted on the driver on at most
SAMPLE_ROWS labelled rows, picked by a hash of doc_id, and PAIRS pairs: their features, about 5 MB, not their texts.

Edge cases: null text counts as empty and is scored like any text; null labels teach nothing, each of several labels of a
document counts; with labels of one kind only, or none, the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sealgrove.llm.texts import bounded_batches, held_out, pieces
from sealgrove.sources.tables import read_table, written

SAMPLE_ROWS, PAIRS = 20_000, 100_000
RIDGE, STEPS, SEED = 1e-3, 25, 7
#: Characters whose share of the words is a feature.
MARKS = tuple(c.encode() for c in "|*#$%&.,\n\"-!?:@/<{(;_=")
N_FEATURES = len(MARKS) + 8


def features(text: str | None) -> list[float]:
    """Sizes, word statistics, shares of marks, capitals and digits, repeated lines."""
    t = text or ""
    raw = t.encode()
    n, words, lines = max(len(raw), 1), raw.lower().split(), raw.split(b"\n")
    nw = max(len(words), 1)
    letters = raw.translate(None, delete=bytes(b for b in range(256) if not 65 <= b <= 90))
    digits = raw.translate(None, delete=bytes(b for b in range(256) if not 48 <= b <= 57))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / nw, len(set(words)) / nw, *(raw.count(m) / nw for m in MARKS),
        len(letters) / n, len(digits) / n, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
    ]


def with_features(df: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """`df` without its text, with the text's features."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)
    rest = [i for i in range(len(df.columns)) if i != at]
    schema = StructType([*(df.schema.fields[i] for i in rest), StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                got = pa.array([features(t) for t in part.column(at).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), got], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def fit_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and threshold of the score w.x; Newton's method on the pairs' logistic loss."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / sd
    rng = np.random.default_rng(SEED)
    m = min(PAIRS, len(good) * len(bad))
    d = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))  # the probability that the preferred one wins
        gradient = d.T @ (1 - p) / m - RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / m + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    threshold = float(np.quantile(z @ w, len(bad) / len(y), method="midpoint"))
    return w / sd, threshold + float(mean @ (w / sd))


def score_column(features: str, labelled: DataFrame) -> tuple[Column, int]:
    """The final score as an expression over the features; `labelled` has features and quality, of which a bounded sample is read."""
    rows = labelled.orderBy("_order", "quality").limit(SAMPLE_ROWS).select("features", "quality").toArrow()
    y = rows.column("quality").to_numpy().astype(np.int64)
    if not 0 < y.sum() < len(y):
        return F.lit(float(y.mean()) if len(y) else 0.5), len(y)
    w, threshold = fit_pairs(np.stack(rows.column("features").to_numpy()).astype(np.float64), y)
    products = F.zip_with(F.col(features), F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b)
    return 1 / (1 + F.exp(-(F.aggregate(products, F.lit(0.0), lambda a, v: a + v) - F.lit(threshold)))), len(y)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """A row for each document: doc_id and `score`. Labels of held-out documents aren't looked at."""
    table = written(with_features(docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))), "quality-features")
    own = labels.select(F.col(doc_id).alias("_doc"), F.col(label).cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("_doc")))
    score, _ = score_column("features", table.join(own, "_doc").withColumn("_order", F.xxhash64("_doc")))
    return table.select(F.col("_doc").alias(doc_id), score.cast("double").alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
