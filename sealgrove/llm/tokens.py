"""Token counts by the whole-token shortcut.

Counts what a SentencePiece BPE model with byte fallback gives for a text, without its ids. Two things are proved once, on the driver and from the
vocabulary alone:

* Where a text may be cut. A merge makes a string of the vocabulary, so it never crosses a place whose two characters stand side by side in no
  string of it. Characters that do are one class; a text falls into pre-tokens, runs of one class with the spaces before them, and each of
  these is encoded by itself.
* Which strings of the vocabulary are whole: exact BPE over their own characters ends with one token.

A pre-token that is whole counts as one, by a look into a table. Only the rest is merged, exactly: short ones all in step, long ones with a heap. Of equal
scores the leftmost pair merges first. Characters that the vocabulary lacks count a token for each byte.

Edge cases: null and empty texts have no tokens; texts of any length are read whole, WORDS_AT_ONCE pre-tokens at a time; control tokens' names in a text are ordinary text;
an existing column of the output's name is replaced, and rows that occur twice are counted twice.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from sealgrove.llm.bpe import Lookup
from sealgrove.llm.texts import appended
from sealgrove.sources.tables import read_table

#: The model's stand-in for a space.
SPACE = "▁"
#: Pre-tokens that are held at once, and merged ones that a task remembers; the longest remembered in characters.
WORDS_AT_ONCE, CACHE_WORDS, CACHE_CHARS = 100_000, 200_000, 40
#: Pre-tokens of up to so many characters are merged in step.
IN_STEP = 64
NEVER = 1 << 40


def classes(strings: list[str]) -> list[str]:
    """Characters that stand side by side in a string, directly or through others, as sorted strings of two or more; spaces count for none."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for s in strings:
        inner = s.lstrip(SPACE)
        for a, b in zip(inner, inner[1:], strict=False):
            parent[root(a)] = root(b)
    found: dict[str, list[str]] = {}
    for c in sorted(parent):
        found.setdefault(root(c), []).append(c)
    return ["".join(x) for x in found.values()]


class Counter:
    """Counts tokens of texts with a vocabulary of (string, score): the pair whose string has the highest score merges first."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        strings = list(dict(vocabulary))
        self.symbol = {s: i for i, s in enumerate(dict.fromkeys([*strings, *(c for s in strings for c in s)]))}
        known = set(strings)
        self.tokens = np.array([1 if s in known else len(s.encode()) for s in self.symbol], dtype=np.int64)
        rank = {x: i for i, x in enumerate(sorted({-x for _, x in vocabulary}))}
        self.merges: dict[int, tuple[int, int]] = {}
        for s, score in vocabulary:
            for cut in range(1, len(s)):
                a, b = self.symbol.get(s[:cut]), self.symbol.get(s[cut:])
                if a is not None and b is not None:
                    self.merges[a << 32 | b] = (rank[-score], self.symbol[s])
        keys = np.array(list(self.merges), dtype=np.int64)
        self.pair = Lookup(keys, np.array([r << 32 | m for r, m in self.merges.values()], dtype=np.int64))
        if any(SPACE in s.lstrip(SPACE) for s in strings):  # a merge may cross any space: only the whole text is a pre-token
            self.words = re.compile("(?s:.+)")
        else:
            runs = [f"[{re.escape(c)}]+" for c in classes(strings)]
            self.words = re.compile(f"(?s:{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+)")
        self.whole = {s: 1 for s, n in zip(strings, self.merged(strings), strict=True) if n == 1}
        self.cache = dict(self.whole)

    def _heap(self, word: str) -> int:
        """Exact BPE of one pre-token: always the pair of the highest score, the leftmost of equals."""
        ids = [self.symbol.get(c, -1 - len(c.encode())) for c in word]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        offer = lambda i, j: (m[0], i, ids[i], ids[j]) if ids[i] >= 0 and ids[j] >= 0 and (m := get(ids[i] << 32 | ids[j])) else None
        heap = [x for i in range(n - 1) if (x := offer(i, i + 1))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j] = self.merges[a << 32 | b][1], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if x := offer(i, k):
                    heapq.heappush(heap, x)
            if (h := before[i]) >= 0 and (x := offer(h, i)):
                heapq.heappush(heap, x)
        return sum(int(self.tokens[x]) if x >= 0 else -1 - x for x, on in zip(ids, alive, strict=True) if on)

    def _in_step(self, words: list[str]) -> np.ndarray:
        """Exact BPE of many pre-tokens; in each step every one merges its first pair."""
        get = self.symbol.get
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = np.array([get(c, -1 - len(c.encode())) for w in words for c in w], dtype=np.int64)
        of, out = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        of, size = of[size > 0], size[size > 0]
        while len(of):
            begin, place = np.cumsum(size) - size, np.arange(len(ids))
            key = np.full(len(ids), NEVER << 22, dtype=np.int64)
            met = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), self.pair.get(np.maximum(ids[:-1], 0) << 32 | np.maximum(ids[1:], 0)), -1)
            key[:-1] = np.where(met < 0, NEVER, met >> 32) << 22 | place[:-1]
            key[begin[1:] - 1] = NEVER << 22
            least = np.minimum.reduceat(key, begin)
            ended = least >> 22 >= NEVER
            gone = np.repeat(ended, size)
            weight = np.where(ids >= 0, self.tokens[np.maximum(ids, 0)], -1 - ids)
            out[of[ended]] = np.add.reduceat(weight, begin)[ended]
            p = least[~ended] & ((1 << 22) - 1)
            ids[p] = met[p] & 0xFFFFFFFF
            keep = ~gone
            keep[p + 1] = False
            ids, of, size = ids[keep], of[~ended], size[~ended] - 1
        return out

    def merged(self, words: list[str]) -> list[int]:
        """How many tokens exact BPE gives for each pre-token."""
        out = [0] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= IN_STEP]
        for i in set(range(len(words))).difference(short):
            out[i] = self._heap(words[i])
        for at in range(0, len(short), 1 << 14):
            part = short[at : at + (1 << 14)]
            for i, n in zip(part, self._in_step([words[i] for i in part]).tolist(), strict=True):
                out[i] = n
        return out

    def _words_of(self, text: str) -> Iterator[list[str]]:
        normal = SPACE + text.replace(" ", SPACE) if text else ""
        if len(normal) <= WORDS_AT_ONCE:
            yield self.words.findall(normal)
            return
        found = (m.group() for m in self.words.finditer(normal))
        while some := list(islice(found, WORDS_AT_ONCE)):
            yield some

    def _flush(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        if len(self.cache) > CACHE_WORDS + len(self.whole):
            self.cache = dict(self.whole)
        rest = list({w for _, p in held for w in p}.difference(self.cache))
        self.cache.update(zip(rest, self.merged(rest), strict=True))
        for i, p in held:
            out[i] += sum(map(self.cache.__getitem__, p))
        for w in rest:
            if len(w) > CACHE_CHARS:
                del self.cache[w]

    def count(self, texts: list[str | None]) -> list[int]:
        """Each text's number of tokens; no more than about twice WORDS_AT_ONCE pre-tokens are held at once."""
        out, held, n = [0] * len(texts), [], 0
        for i, t in enumerate(texts):
            for some in self._words_of(t or ""):
                held.append((i, some))
                n += len(some)
                if n >= WORDS_AT_ONCE:
                    self._flush(held, out)
                    held, n = [], 0
        self._flush(held, out)
        return out

    def forget(self) -> None:
        """Gives the memory of merged pre-tokens back, as Python workers outlive their tasks."""
        self.cache = dict(self.whole)


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(string, score) of a SentencePiece model's ordinary strings, read on the driver. Its size is the vocabulary's, whatever the corpus.

    The model must be BPE with byte fallback that leaves texts as they are but for a space before them and SPACE in place of spaces.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    n, t = model.normalizer_spec, model.trainer_spec
    plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not t.treat_whitespace_as_suffix
    kinds = pb.ModelProto.SentencePiece
    if not plain or t.model_type != pb.TrainerSpec.BPE or not t.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: not a BPE model with byte fallback over plain text")
    names = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(names.id_to_piece(i), p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]


def with_token_counts(df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", counter: Counter | None = None) -> DataFrame:
    """`df` with the number of tokens of its texts, in one pass and without a shuffle. The vocabulary's tables are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(counter or Counter(vocabulary()))
    return appended(df, [StructField(n_tokens, LongType())], lambda texts: [shared.value.count(texts)], text, lambda: shared.value.forget())


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


QUERIES = {"op12_tokens": op12_tokens}
ORACLES: dict[str, str] = {}
