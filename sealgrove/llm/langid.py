"""Language ID by language-bitmask n-gram filters.

Learning counts, over all documents whose language is known, in how many documents of each language a letter 3-gram occurs, and
keeps for a language those in at least MIN_SHARE of its documents. The kept n-grams go into one bit-sliced Bloom filter: a slot
holds a bit for each language, and the AND of an n-gram's slots is the set of all languages that contain it. A text's distinct
n-grams give each language a popcount; it is corrected for false positives by the language's fill, and the largest decides.
The score is the corrected share of the text's n-grams that the language contains, each counted as often as it occurs, so that it doesn't
fall with the text's length. A slot has as many words of 64 bits as the languages need.

The kept n-grams of a language are at most (mean distinct n-grams of a document / MIN_SHARE), whatever the corpus, so the
filter has a fixed size and is built on the driver.

Edge cases: null text and text without a letter are `und` with score 0, and so is everything when nothing was learned; ties go
to the language first by code point; case and anything but letters are ignored; rows of null language teach nothing; an
existing column of an output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from sealgrove.llm.texts import appended, bounded_batches, held_out
from sealgrove.sources.tables import read_table

UND = "und"
#: A language keeps the n-grams of at least this share of its documents, and of two if it has so many.
MIN_SHARE = 0.03
SLOT_BITS, PROBES = 18, 3
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def counted_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 3-grams of a text's words, a word having one blank at either end, and how often they occur."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not len(c):
        return c, c
    c = np.concatenate([[0], np.where(_letters()[c], c, 0), [0]])
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    g = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    return np.unique(g[c[1:-1] != 0], return_counts=True)


def grams(text: str | None) -> np.ndarray:
    return counted_grams(text)[0]


def slots(g: np.ndarray) -> list[np.ndarray]:
    out = []
    for m in MIXERS[:PROBES]:
        h = (g.astype(np.uint64) ^ np.uint64(m >> 7)) * np.uint64(m)
        h ^= h >> np.uint64(29)
        out.append(((h * np.uint64(MIXERS[0])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return out


class Filter:
    """The bit-sliced Bloom filter and its languages in order of their bits."""

    def __init__(self, kept: dict[str, np.ndarray]):
        self.langs = sorted(kept)
        self.masks = np.zeros((1 << SLOT_BITS, max(1, -(-len(self.langs) // 64))), dtype=np.uint64)
        for k, lang in enumerate(self.langs):
            for s in slots(kept[lang]):
                self.masks[s, k // 64] |= np.uint64(1 << k % 64)
        fill = np.array([self._has(self.masks, k).mean() for k in range(len(self.langs))])
        self.false = fill**PROBES

    @staticmethod
    def _has(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    def languages(self, g: np.ndarray) -> np.ndarray:
        """For each n-gram the set of languages that contain it, as a row of bit masks."""
        found = np.full((len(g), self.masks.shape[1]), ~np.uint64(0))
        for s in slots(g):
            found &= self.masks[s]
        return found

    def decide(self, text: str | None) -> tuple[str, float]:
        g, n = counted_grams(text)
        if not len(g) or not self.langs:
            return UND, 0.0
        m = self.languages(g)
        hits = np.array([np.count_nonzero(self._has(m, k)) for k in range(len(self.langs))])
        best = int(np.argmax((hits / len(g) - self.false) / np.maximum(1 - self.false, 1e-9)))
        share = n[self._has(m, best) > 0].sum() / n.sum()
        return self.langs[best], float(np.clip((share - self.false[best]) / max(1 - self.false[best], 1e-9), 0, 1))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> Filter:
    """The filter learned from all rows of `df` with a language."""
    bounded_batches(df.sparkSession)
    known = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, texts in frame.groupby("lang")["text"]:
                g, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": g, "n": n})

    counts = known.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, float(max(min(2.0, n), min_share * n))))) if sizes else F.lit(None).cast("map<string,double>")
    rows = counts.filter(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toPandas()
    return Filter({k: rows.loc[rows["lang"] == k, "gram"].to_numpy(dtype=np.int64) for k in sizes})


def predict(df: DataFrame, model: Filter, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`df` with the predicted language and its score; only the text is looked at."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [StructField(lang_pred, StringType()), StructField(score, DoubleType())]

    def decide(texts: list) -> list[list]:
        got = [shared.value.decide(t) for t in texts]
        return [[x[0] for x in got], [x[1] for x in got]]

    return appended(df, fields, decide, text)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_langid": op3_langid}
ORACLES: dict[str, str] = {}
