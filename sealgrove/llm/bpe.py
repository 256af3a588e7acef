"""BPE encoding and decoding: speculate and verify.

A text is cut into words by the tokenizer's pattern. For each word not met before, greedy longest match proposes tokens.
A sequence of tokens is the word's BPE encoding exactly if every adjacent pair is compatible, that is if BPE over the two
tokens' bytes never merges across the boundary between them. The check walks both tokens' merges back in time, for all
adjacent pairs of a batch of words at once. Only words with an incompatible pair are merged exactly: short ones all in step,
long ones with a heap.

Encoding equals the tokenizers library's for byte-level BPE files without normaliser and with add_special_tokens=False;
special tokens' own strings in a text become their ids. Decoding is the inverse; ids that aren't in the vocabulary are
skipped, and bytes that aren't UTF-8 become U+FFFD.

Edge cases: null and empty texts have no ids, null ids decode to null; texts of any length are read whole, WORDS_AT_ONCE words
at a time; an existing column of an output's name is replaced; rows that occur twice are encoded twice, and an empty table
gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField

from sealgrove.llm.texts import appended
from sealgrove.sources.tables import read_table

#: Fixed value: the byte-level pattern of the vocabulary's family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task keeps with their ids, and the longest of them in characters; for speed only.
CACHE_WORDS, CACHE_CHARS = 100_000, 40
#: Words that are held at once.
WORDS_AT_ONCE = 100_000
#: Words of up to so many bytes are merged in step, longer ones one by one.
IN_STEP = 64
NEVER = 1 << 40


def byte_chars() -> dict[str, int]:
    """The printable stand-in characters of bytes: printable Latin-1 stands for itself, the others are shifted to U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """A hash table of non-negative integers, asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left, at = left[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 for keys that aren't in the table."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Bpe:
    """The tables of a byte-level BPE vocabulary and its encoder for batches of words."""

    def __init__(self, data: str):
        spec = json.loads(data)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        model = spec["model"]
        vocab = {raw(t): i for t, i in model["vocab"].items()}
        n = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.bytes_of: list[bytes] = [b""] * n
        for t, i in vocab.items():
            self.bytes_of[i] = t
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.rank = np.full(n, -1, dtype=np.int64)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (vocab[raw(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            made = vocab[self.bytes_of[a] + self.bytes_of[b]]
            self.merges.setdefault(a << 32 | b, (rank, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        pairs = np.array(list(self.merges), dtype=np.int64)
        ranks, mades = (np.array(x, dtype=np.int64) for x in zip(*self.merges.values(), strict=True))
        self.pair = Lookup(pairs, ranks << 32 | mades)  # the rank of a pair's merge and what it makes
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int64)
        # A token that its own bytes don't encode to, or that a later merge made again, must not be proposed.
        tokens = [t for t, i in vocab.items() if len(t) > 1 and self.rank[i] >= 0]
        whole = [t for t, x in zip(tokens, self.merge_words(tokens), strict=True) if x == np.array([vocab[t]], dtype="<u4").tobytes()]
        self._plant({t: vocab[t] for t in [*(bytes([b]) for b in range(256)), *whole]})
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.cache, self.older = self._fresh_cache(), {}

    def _plant(self, usable: dict[bytes, int]) -> None:
        """A trie of the tokens that may be proposed."""
        children: dict[int, int] = {}
        token = [-1]
        for t, i in usable.items():
            node = 0
            for b in t:
                node = children.setdefault(node << 8 | b, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.trie = Lookup(np.array(list(children), dtype=np.int64), np.array(list(children.values()), dtype=np.int64))
        self.token = np.array(token, dtype=np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word with a heap: always the pair of lowest rank, the leftmost of equals."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a << 32 | b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := get(ids[h] << 32 | ids[i])):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _ranked(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the merges of pairs, with the place in the low bits; NEVER << 22 where there is none."""
        found = self.pair.get(x << 32 | y)
        return np.where(found < 0, NEVER, found >> 32) << 22 | at

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Exact BPE of many words; in each step every word merges its pair of lowest rank, the leftmost of equals."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= IN_STEP]
        for i in set(range(len(words))) - set(short):
            out[i] = np.array(self.merge(words[i]), dtype="<u4").tobytes()
        for at in range(0, len(short), 1 << 14):
            part = short[at : at + (1 << 14)]
            of = np.array(part, dtype=np.int64)
            size = np.array([len(words[i]) for i in part], dtype=np.int64)
            of, size = of[size > 0], size[size > 0]
            ids = self.byte_id[np.frombuffer(b"".join(words[i] for i in part), dtype=np.uint8)]
            while len(of):
                begin = np.cumsum(size) - size
                place = np.arange(len(ids))
                key = np.full(len(ids), NEVER << 22, dtype=np.int64)
                key[:-1] = self._ranked(ids[:-1], ids[1:], place[:-1])
                key[begin[1:] - 1] = NEVER << 22
                key[-1] = NEVER << 22
                least = np.minimum.reduceat(key, begin)
                ended = least >> 22 == NEVER
                if ended.any():
                    gone = np.repeat(ended, size)
                    flat, cut = ids[gone].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(size[ended])]) * 4
                    for i, a, b in zip(of[ended].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        out[i] = flat[a:b]
                p = least[~ended] & ((1 << 22) - 1)
                ids[p] = self.pair.get(ids[p] << 32 | ids[p + 1]) & 0xFFFFFFFF
                keep = np.ones(len(ids), dtype=bool)
                keep[p + 1] = False
                if ended.any():
                    keep &= ~gone
                ids, of, size = ids[keep], of[~ended], size[~ended] - 1
        return out

    def propose(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: the tokens of all words one after the other, and how many each word has.

        The longest token is found for each place of all words at once, then those that follow one another from a word's begin.
        """
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        stop = np.cumsum(size)
        end = np.repeat(stop, size)
        best, length = np.full(len(flat), -1, dtype=np.int64), np.zeros(len(flat), dtype=np.int64)
        at, node, depth = np.arange(len(flat)), np.zeros(len(flat), dtype=np.int64), 0
        while len(at):
            node = self.trie.get(node << 8 | flat[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
            made = self.token[node]
            best[at[made >= 0]], length[at[made >= 0]] = made[made >= 0], depth
            inside = at + depth < end[at]
            at, node = at[inside], node[inside]
        chosen = np.zeros(len(flat), dtype=bool)
        at = (stop - size)[(size > 0) & (size <= IN_STEP)]
        while len(at):
            chosen[at] = True
            after = at + length[at]
            at = after[after < end[at]]
        for w in np.flatnonzero(size > IN_STEP).tolist():
            i, step = 0, length[stop[w] - size[w] : stop[w]].tolist()
            own = []
            while i < len(step):
                own.append(i)
                i += step[i]
            chosen[stop[w] - size[w] + np.array(own)] = True
        counts = np.concatenate([[0], np.cumsum(chosen)])
        return best[chosen], counts[stop] - counts[stop - size]

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether BPE over the bytes of x and y leaves the boundary between them alone, for arrays of pairs.

        Both sides are taken apart in the reverse order of their merges. A pair (a, b) that meets at the boundary merges there
        if its rank comes before the merge that takes a away, or no later than the one that takes b away: of equal ranks the
        leftmost merges first.
        """
        good = np.ones(len(x), dtype=bool)
        at, x, y = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(at):
            found = self.pair.get(x << 32 | y)
            rank = np.where(found < 0, NEVER, found >> 32)
            crossed = (rank < until_x) & (rank <= until_y)
            good[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, until_x, until_y, rx, ry = (v[go] for v in (at, x, y, until_x, until_y, rx, ry))
            undo_x = rx > ry
            until_x, until_y = np.where(undo_x, rx, until_x), np.where(undo_x, until_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        flat, sizes = self.propose(raw)
        ends = np.cumsum(sizes)
        inner = np.ones(max(len(flat) - 1, 0), dtype=bool)
        inner[ends[:-1] - 1] = False  # the last of a word and the first of the next
        pairs = np.flatnonzero(inner)
        broken = pairs[~self.compatible(flat[pairs], flat[pairs + 1])]
        data, cut = flat.astype("<u4").tobytes(), (np.concatenate([[0], ends]) * 4).tolist()
        out = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        failed = np.unique(np.searchsorted(ends, broken, side="right")).tolist()
        for w, x in zip(failed, self.merge_words([raw[w] for w in failed]), strict=True):
            out[w] = x
        return out

    def _words_of(self, text: str) -> Iterator[list[str]]:
        """The words of a text in order, at most WORDS_AT_ONCE at a time; special tokens are words of their own."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]  # the texts between and the special tokens in turn
        for k, part in enumerate(parts):
            if k % 2:
                yield [part]
            elif len(part) <= WORDS_AT_ONCE:
                yield self.words.findall(part)
            else:
                found = (m.group() for m in self.words.finditer(part))
                while some := list(islice(found, WORDS_AT_ONCE)):
                    yield some

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        """Encodes the words of the texts' pieces. Words that were met lately are in one of two caches; the older is dropped when the younger is full."""
        young, old, fresh = self.cache, self.older, {}
        for w in {w for _, p in held for w in p}.difference(young):
            fresh[w] = old.get(w)
        new = [w for w, x in fresh.items() if x is None]
        fresh.update(zip(new, self.encode_words(new), strict=True))
        long = [w for w in fresh if len(w) > CACHE_CHARS]
        young.update(fresh)
        for i, p in held:
            out[i].append(b"".join(map(young.__getitem__, p)))
        for w in long:
            del young[w]
        if len(young) > CACHE_WORDS:
            self.cache, self.older = self._fresh_cache(), young

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; no more than about twice WORDS_AT_ONCE words are held at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        pieces: list[tuple[int, list[str]]] = []
        held = 0
        for i, t in enumerate(texts):
            for some in self._words_of(t):
                pieces.append((i, some))
                held += len(some)
                if held >= WORDS_AT_ONCE:
                    self._flush(pieces, out)
                    pieces, held = [], 0
        self._flush(pieces, out)
        return [b"".join(x) for x in out]

    def forget(self) -> None:
        """Gives the memory of the words back, as Python workers outlive their tasks."""
        self.cache, self.older = self._fresh_cache(), {}

    def _fresh_cache(self) -> dict[str, bytes]:
        """Special tokens are cut out of a text before words are, so that no word equals one."""
        return {s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()}

    def decode(self, ids: bytes) -> str:
        at = np.frombuffer(ids, dtype="<u4")
        if len(at) and at.max() >= len(self.bytes_of):
            at = at[at < len(self.bytes_of)]
        return b"".join(map(self.bytes_of.__getitem__, at.tolist())).decode("utf-8", "replace")


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's file, read on the driver. Its size is the vocabulary's, whatever the corpus."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, text: str = "text", ids: str = "ids", bpe: Bpe | None = None) -> DataFrame:
    """`df` with `ids`: the text's token ids as little-endian unsigned 32-bit integers. The vocabulary's tables are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(bpe or Bpe(vocabulary()))
    return appended(df, [StructField(ids, BinaryType())], lambda texts: [shared.value.encode([t or "" for t in texts])], text, lambda: shared.value.forget())


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", bpe: Bpe | None = None) -> DataFrame:
    """`df` with `text` decoded from `ids`."""
    shared = df.sparkSession.sparkContext.broadcast(bpe or Bpe(vocabulary()))
    return appended(df, [StructField(text, StringType())], lambda rows: [[None if x is None else shared.value.decode(x) for x in rows]], ids)


def encode_and_decode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", bpe: Bpe | None = None) -> DataFrame:
    """`df` with `ids` and what they decode to: encode and decode in one pass over the rows, with one copy of the tables in a worker."""
    shared = df.sparkSession.sparkContext.broadcast(bpe or Bpe(vocabulary()))

    def both(texts: list) -> list[list]:
        found = shared.value.encode([t or "" for t in texts])
        return [found, [shared.value.decode(x) for x in found]]

    return appended(df, [StructField(ids, BinaryType()), StructField(decoded, StringType())], both, text, lambda: shared.value.forget())


def round_trip(docs: DataFrame) -> DataFrame:
    """Documents with n_tokens and digests of the ids and of the decoded text."""
    out = encode_and_decode(docs)
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns if c != "text"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
