"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set. Fingerprints within `guaranteed` bits
are found so: bits are grouped into parts, correlated ones together; for each fingerprint, thresholds t_i of at least -1 are
allocated to the parts with sum(t_i + 1) = guaranteed + 1, so that any fingerprint within `guaranteed` bits differs in at most t_i
bits from it in some part i. A dynamic programme picks the thresholds of least cost, from the number of keys to look up and
the candidates that histograms of half parts let expect: parts with a popular value are skipped or matched exactly, rare ones
searched more widely. The looked-up keys meet the parts of all fingerprints in a join, whose condition verifies the distance.

Before that, each fingerprint is compared with the smallest one of each of its parts' values. The components of these links are labels;
in the join after that only fingerprints of different labels make pairs, so a group of m near copies costs links in proportion to m
instead of all its pairs. Where texts are compared, too, components of the near pairs, before their texts have been seen, are regions: within
a region texts of different labels are held against each other in blocks, and only regions make pairs in the join.

Two ways to say what is near: by distance alone (`similarity` None, one lane, all pairs within max_distance), or by the Jaccard
similarity of the texts' distinct shingles (the default, 4 / 5). Then fingerprints have many lanes, of which the last only checks: its
distance must be within max_distance, which a pair of that similarity misses less than once in a thousand. Candidates are verified by
the exact similarity of their texts, from 64-bit hashes of shingles, those first left out whose lanes differ in over APART of all bits. With
12 lanes and 48 parts of 16 bits a pair is looked up for certain within 47 of 768 bits; of pairs farther apart those are found that agree in
a part (README has the measured share at 0.8). Parts of 16 bits suit tens of millions of texts; for more, as comparisons grow with the square
of their number over 2 ** 16, wider parts and more lanes: 32 lanes of 3 parts find as many.

Texts: A-Z are lower-cased; words are runs of anything but ASCII white space; shingles of `words` words, repeats included unless
similarity is asked for. Fewer words than that are one shingle, and no words (null and empty texts too) give fingerprint zero,
which links like any other.

Edge cases: repeated rows and equal texts share a fingerprint and so a component; rows of equal doc_id are rows like any other; a null
doc_id never names a component unless nothing else is in it, which then has none (null); an empty table gives an empty table;
columns of the input that aren't asked for by `extra` aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sealgrove.llm.components import connected
from sealgrove.llm.texts import bounded_batches, pieces
from sealgrove.operators.joins import numbered
from sealgrove.sources.tables import read_table, remove, written

SEED = 42
#: What a candidate costs that a join compares, against a key that is looked up: a key is shuffled with its fingerprint, a candidate isn't.
CANDIDATE_COST = 0.005
#: Parts are searched up to this many differing bits.
MOST_FLIPS = 3
#: Similarity of 4 / 5, and lanes, parts of a lane, guaranteed bits and distance in the checking lane that go with it.
SIMILARITY, LANES, PARTS, GUARANTEED, CHECKED = (4, 5), 12, 4, 47, 19
#: Before texts are compared: the share of all lanes' bits that may differ. At that similarity it is 0.15, for unlike texts 0.5.
APART = 0.22
#: Ids of texts to look at that are broadcast, 24 bytes each.
BROADCAST_IDS = 2_000_000
#: Texts of a block whose pairs are compared in one task, and tokens that are looked at together.
BLOCK, BLOCK_TOKENS, COLUMNS = 128, 1 << 17, 4096
#: Tokens of texts that a task of the verification keeps, 8 bytes each.
TOKENS_HELD = 2_000_000
#: Shingles that are hashed at once, and counters of a byte.
AT_ONCE, BYTE = 1 << 16, 255


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the runs of `words` words in order, or of all words if there are fewer; none of a text without words."""
    own = (text or "").encode().lower().split()  # bytes: only ASCII letters and white space count
    if not own:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
    starts = np.concatenate([[0], ends[: max(len(own) - words, 0)]])
    ends = ends[min(words, len(own)) - 1 :] - 1
    del own
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), AT_ONCE):
        some = zip(starts[at : at + AT_ONCE].tolist(), ends[at : at + AT_ONCE].tolist(), strict=True)
        out[at : at + AT_ONCE] = np.fromiter((xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in some), dtype=np.uint64)
    return out


def token_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes, sorted; texts without words have one token in common."""
    h = np.unique(shingle_hashes(text, words))
    return h if len(h) else np.zeros(1, dtype=np.uint64)


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes for lane k: lane 0 takes them as they are, the others a mix that differs by lane."""
    if not k:
        return h
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of hashes of the given sizes (none is 0) the 64 bits that over half of a run's hashes have set.

    Eight counters of a byte are added in one word; runs of more than 255 hashes are cut into several and added up.
    """
    cuts = -(-sizes // BYTE)
    run = np.repeat(np.arange(len(sizes)), cuts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = np.repeat(np.cumsum(sizes) - sizes, cuts) + nth * BYTE
    first = np.cumsum(cuts) - cuts
    counts = np.zeros((len(sizes), 8, 8), dtype=np.int64)  # run, byte, bit
    for b in range(8):
        some = np.add.reduceat(h >> np.uint64(b) & np.uint64(0x0101010101010101), begin)
        counts[:, :, b] = np.add.reduceat(some.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = 2 * counts.reshape(len(sizes), 64) > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: list[str | None], words: int, lanes: int, distinct: bool = False) -> np.ndarray:
    """`lanes` 64-bit integers for each text."""
    out = np.zeros((len(texts), lanes), dtype=np.uint64)
    own = [(np.unique if distinct else np.asarray)(shingle_hashes(t, words)) for t in texts]
    full = np.array([i for i, x in enumerate(own) if len(x)], dtype=np.int64)
    if len(full):
        h, sizes = np.concatenate([own[i] for i in full]), np.array([len(own[i]) for i in full], dtype=np.int64)
        for k in range(lanes):
            out[full, k] = _majority(_lane(h, k), sizes)
    return out


def lanes_of(lanes: int) -> list[str]:
    return [f"_w{k}" for k in range(lanes)]


def fingerprints(df: DataFrame, text: str = "text", words: int = 5, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """`df` with its texts' fingerprints in the columns lanes_of(lanes), without the text."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)
    rest = [i for i in range(len(df.columns)) if i != at]
    fields = [df.schema.fields[i] for i in rest] + [StructField(c, LongType()) for c in lanes_of(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                w = fingerprints_of(part.column(at).to_pylist(), words, lanes, distinct).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *(pa.array(np.ascontiguousarray(w[:, k])) for k in range(lanes))], names=[f.name for f in fields])

    return df.mapInArrow(run, StructType(fields))


def _bits(frame: pd.DataFrame, names: list[str]) -> np.ndarray:
    w = np.ascontiguousarray(frame[names].to_numpy(dtype=np.int64)).astype("<i8")
    return np.unpackbits(w.view(np.uint8).reshape(len(w), -1), axis=1, bitorder="little")


def _project(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def group_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal width: each starts with the bit that correlates most and takes the bits that go with it."""
    mean = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out, total = list(range(len(mean))), [], len(mean)
    for k in range(parts):
        width = total // parts + (k < total % parts)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        while len(own) < width:
            own.append(max((b for b in free if b not in own), key=lambda b: (corr[b, own].sum(), -b)))
        free = [b for b in free if b not in own]
        out.append(sorted(own))
    return out


def _halves(parts: list[list[int]]) -> list[list[int]]:
    return [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]


def near_shares(counts: np.ndarray, most: int = MOST_FLIPS) -> np.ndarray:
    """[value, d]: the share of fingerprints whose half part differs from the value in exactly d bits."""
    width, total = len(counts).bit_length() - 1, max(counts.sum(), 1)
    v = np.arange(len(counts))
    out = np.zeros((len(counts), most + 1))
    for d in range(min(most, width) + 1):
        for flips in combinations(range(width), d):
            out[:, d] += counts[v ^ sum(1 << b for b in flips)]
    return out / total


def allocate(shares: list[tuple[np.ndarray, np.ndarray]], widths: list[int], n: int, guaranteed: int, most: int = MOST_FLIPS) -> np.ndarray:
    """[fingerprint, part]: thresholds of least total cost with sum(t + 1) = guaranteed + 1, by dynamic programming.

    shares: for each part, what near_shares gives for both halves of each fingerprint.
    """
    size, goal = len(shares[0][0]), guaranteed + 1
    best = np.full((goal + 1, size), np.inf)
    best[0] = 0
    picks = []
    for (a, b), width in zip(shares, widths, strict=True):
        cost, keys, seen = [np.zeros(size)], 0, np.zeros(size)
        for t in range(min(most, width) + 1):
            keys += len(list(combinations(range(width), t)))
            seen = seen + sum(a[:, d] * b[:, t - d] for d in range(t + 1))
            cost.append(keys + CANDIDATE_COST * n * seen)
        now, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for s in range(goal + 1):
            for u in range(min(len(cost) - 1, s) + 1):
                total = best[s - u] + cost[u]
                better = total < now[s]
                now[s] = np.where(better, total, now[s])
                pick[s] = np.where(better, u, pick[s])
        best = now
        picks.append(pick)
    out, left, row = np.zeros((size, len(widths)), dtype=np.int64), np.full(size, goal), np.arange(size)
    for i in range(len(widths) - 1, -1, -1):
        u = picks[i][left, row].astype(np.int64)
        out[:, i] = u - 1
        left -= u
    return out


def _sums(df: DataFrame, f, size: int) -> np.ndarray:
    """Sums over all partitions of the vector of `size` counts that f gives for a frame; its size is fixed, whatever the input."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for frame in frames:
            total += f(frame)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "n": total[at]})

    out = np.zeros(size, dtype=np.int64)
    got = df.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out[got["k"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def keyed(prints: DataFrame, lanes: int, parts: int, guaranteed: int) -> DataFrame:
    """(id, shown, keys, kinds): for each distinct fingerprint the keys it is found by and those it looks up, a key being a part and a value.

    kind 0: the part's value that the fingerprint is found by; 1: one that it looks up, too; 2: a value that it looks up only.
    """
    names = lanes_of(lanes)
    n = prints.count()

    def joint(frame: pd.DataFrame) -> np.ndarray:
        b = _bits(frame, names).astype(np.float32).reshape(len(frame), lanes, 64).transpose(1, 0, 2)
        return np.rint(b.transpose(0, 2, 1) @ b).astype(np.int64).ravel()

    # Parts are made of bits of one lane: lanes are hashed apart.
    together = _sums(prints, joint, lanes * 64 * 64).reshape(lanes, 64, 64)
    groups = [[64 * k + b for b in g] for k in range(lanes) for g in group_bits(together[k], n, parts)]
    halves = _halves(groups)
    start = np.cumsum([0, *(1 << len(h) for h in halves)])

    def histogram(frame: pd.DataFrame) -> np.ndarray:
        b = _bits(frame, names)
        return np.bincount(np.concatenate([start[i] + _project(b, h) for i, h in enumerate(halves)]), minlength=int(start[-1]))

    counts = _sums(prints, histogram, int(start[-1]))
    shares = [near_shares(counts[start[i] : start[i + 1]]).astype(np.float32) for i in range(len(halves))]
    widths = [len(g) for g in groups]
    masks = [[np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(w), d)], dtype=np.int64) for t in range(MOST_FLIPS + 1)] for w in widths]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            b, m = _bits(frame, names), len(frame)
            near = [s[_project(b, h)] for s, h in zip(shares, halves, strict=True)]
            t = allocate(list(zip(near[::2], near[1::2], strict=True)), widths, n, guaranteed)
            rows, keys, kinds = [], [], []
            for i, g in enumerate(groups):
                own = _project(b, g)
                rows.append(np.arange(m))
                keys.append(own | i << 32)
                kinds.append((t[:, i] >= 0).astype(np.int8))
                for flips in range(1, MOST_FLIPS + 1):
                    wide = np.flatnonzero(t[:, i] == flips)
                    if len(wide):
                        other = own[wide, None] ^ masks[i][flips][None, 1:]
                        rows.append(np.repeat(wide, other.shape[1]))
                        keys.append(other.ravel() | i << 32)
                        kinds.append(np.full(other.size, 2, dtype=np.int8))
            row, key, kind = (np.concatenate(x) for x in (rows, keys, kinds))
            order = np.argsort(row, kind="stable")
            cut = np.cumsum(np.bincount(row, minlength=m))[:-1]
            yield pd.DataFrame({"id": frame["id"], "shown": frame["shown"], "keys": np.split(key[order], cut), "kinds": np.split(kind[order], cut)})

    made = prints.select("id", "shown", *names).mapInPandas(run, "id long, shown long, keys array<long>, kinds array<tinyint>")
    return written(made, "simhash-keys")


def reached(df: DataFrame, asked: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of a large table with a few of its rows' keys: these are broadcast up to BROADCAST_IDS rows, beyond that both are shuffled."""
    return df.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, on, how)


def _text_ids(text: str) -> list:
    """128 bits of hash that tell texts apart."""
    return [F.xxhash64(text).alias("_t0"), F.xxhash64(F.lit(1), text).alias("_t1")]


def _similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of ids whose texts have the similarity. `texts` (_text) is searched for the text of each id that is in a pair."""
    part, whole = similarity
    names = [c for c in prints.columns if c.startswith("_w")]
    lanes = lambda side: prints.select(F.col("id").alias(side), F.array(*names).alias(f"_{side}"))
    differ = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = pairs.join(lanes("a"), "a").join(lanes("b"), "b").filter(differ <= int(APART * 64 * len(names))).select("a", "b")
    pairs = written(pairs, "simhash-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    asked = written(prints.join(ids, "id").select("id", "rep.*"), "simhash-asked")
    found = reached(texts.select("_text", *_text_ids("_text")), asked, ["_t0", "_t1"]).groupBy("id").agg(F.any_value("_text").alias("_text"))
    found = written(found, "simhash-texts")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}  # a text is in several pairs
        held = 0
        for batch in batches:
            keep = []
            for row, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for side, i in enumerate(pair):
                    if i not in of:
                        of[i] = token_set(batch.column(2 + side)[row].as_py(), words)
                        held += len(of[i])
                x, y = of[pair[0]], of[pair[1]]
                both, least = len(x) + len(y), min(len(x), len(y))
                possible = (part + whole) * least >= part * both  # by their sizes
                keep.append(possible and (part + whole) * (both - len(np.unique(np.concatenate([x, y])))) >= part * both)
                if held > TOKENS_HELD:
                    of, held = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(found.select(F.col("id").alias("a"), F.col("_text").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("_text").alias("y")), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "simhash-similar")
    for table in (found, asked, pairs):
        remove(pairs.sparkSession, table)
    return out


def _alike(x: list, y: list, same: bool, limit: int, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between the texts of two blocks, items of (id, label, lanes, tokens): no more than it takes to join the labels that similar texts have."""
    part, whole = similarity

    def columns(items: list) -> tuple:
        lanes = np.array([i["lanes"] for i in items], dtype=np.int64).view(np.uint64)
        return [i["id"] for i in items], np.array([i["label"] for i in items]), lanes, [np.frombuffer(i["tokens"], dtype=np.uint64) for i in items]

    (ids_x, label_x, lanes_x, tokens_x), (ids_y, label_y, lanes_y, tokens_y) = columns(x), columns(y)
    open_ = label_x[:, None] != label_y[None]
    if same:
        open_ = np.triu(open_, 1)
    for i in np.flatnonzero(open_.any(axis=1)):
        open_[i] &= np.bitwise_count(lanes_x[i][None] ^ lanes_y).sum(axis=1) <= limit
    if not open_.any():
        return []
    sizes_x, sizes_y = (np.array([len(t) for t in z]) for z in (tokens_x, tokens_y))
    _, at, counts = np.unique(np.concatenate([*tokens_x, *tokens_y]), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(x) + len(y)), np.concatenate([sizes_x, sizes_y])), (counts > 1)[at]
    column = (np.cumsum(counts > 1) - 1)[at]  # tokens of a single text count for none
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(x), len(y)))
    for first in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        m = np.zeros((len(x) + len(y), COLUMNS), dtype=np.float32)
        m[row[a:b], column[a:b] - first] = 1
        both += m[: len(x)] @ m[len(x) :].T
    found = open_ & ((part + whole) * both >= part * (sizes_x[:, None] + sizes_y[None]))
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    out = []
    for i, j in np.argwhere(found).tolist():
        a, b = root(int(label_x[i])), root(int(label_y[j]))
        if a != b:
            parent[a] = b
            out.append((ids_x[i], ids_y[j]))
    return out


def _within(prints: DataFrame, texts: DataFrame, near: DataFrame, star: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links that join the texts of one region, all of whose pairs are held against each other.

    A region is a component of the near pairs, a label one of the verified links. The texts of a region with several labels are sorted by size, in powers of two, and label, and cut into blocks of up to BLOCK texts
    and about BLOCK_TOKENS tokens. Two blocks meet in a task if their sizes are next to each other, as no text is similar to one of less than half its size, unless both are of one and the same label; only links come out. So a group of m near copies whose texts lie just below the similarity makes (m / BLOCK)^2 / 2 rows instead of m^2 / 2.
    """
    names = [c for c in prints.columns if c.startswith("_w")]
    regions = connected(near, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("region"))
    labels = connected(star, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("label"))
    members = written(regions.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "simhash-regions")
    mixed = members.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("region")
    members = written(members.join(mixed, "region"), "simhash-members")
    asked = written(prints.join(members.select("id"), "id").select("id", "rep.*"), "simhash-asked")
    found = reached(texts.select("_text", *_text_ids("_text")), asked, ["_t0", "_t1"]).select("id", "_text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([token_set(t, words).tobytes() for t in piece.column(1).to_pylist()], pa.binary())], names=["id", "tokens"])

    once = written(found.groupBy("id").agg(F.any_value("_text").alias("_text")).mapInArrow(tokens, "id long, tokens binary"), "simhash-tokens")
    sizes = members.join(once.select("id", F.floor(F.log2(F.octet_length("tokens") / 8)).cast("int").alias("size")), "id")
    chunk = F.expr(f"shiftleft(cast(size as bigint), 40) + n div least({BLOCK}, greatest(1, shiftright({BLOCK_TOKENS}, size)))")
    members = numbered(sizes, ("region", "size"), ("label", "id")).withColumn("chunk", chunk).drop("n", "size")
    item = F.struct("id", "label", F.array(*names).alias("lanes"), "tokens")
    chunks = members.join(once, "id").join(prints.select("id", *names), "id").groupBy("region", "chunk").agg(F.collect_list(item).alias("items"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    chunks = written(chunks, "simhash-chunks")
    ends = chunks.select("region", "chunk", "lo", "hi")
    b = ends.select("region", F.col("chunk").alias("other"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    met = ends.join(b, "region").filter("chunk <= other and shiftright(other, 40) - shiftright(chunk, 40) <= 1 and not (lo = hi and _lo = _hi and lo = _lo)").select("region", "chunk", "other")
    met = met.join(chunks.select("region", "chunk", F.col("items").alias("x")), ["region", "chunk"])
    met = met.join(chunks.select("region", F.col("chunk").alias("other"), F.col("items").alias("y")), ["region", "other"])
    limit = int(APART * 64 * len(names))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].as_py() for c in (1, 2))
                if links_ := _alike(x, y, batch.column(0)[k].as_py(), limit, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links_, strict=True)], names=["a", "b"])

    return written(met.select((F.col("chunk") == F.col("other")).alias("same"), "x", "y").mapInArrow(compare, "a long, b long"), "simhash-within")


def links(prints: DataFrame, lanes: int, max_distance: int, parts: int, guaranteed: int, verify=None, within=None) -> DataFrame:
    """(a, b): ids of fingerprints that are near, from a table of distinct ones (id, shown and lanes_of(lanes)).

    `shown` is compared: pairs within max_distance bits of it are near, or those of them that `verify` lets pass. All near pairs within
    `guaranteed` bits of the lanes are links or have links to common third fingerprints; of those farther apart, the ones that share a key.
    `within(near, star)`: links inside the components of the near pairs, which then aren't formed as pairs.
    """
    spark = prints.sparkSession
    verify = verify or (lambda pairs: pairs)
    near = lambda x, y: f"bit_count({x}.shown ^ {y}.shown) <= {max_distance}"
    keys = keyed(prints, lanes, parts, guaranteed)

    def rows(df: DataFrame, kinds: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("keys", "kinds")]
        return df.select(*rest, F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("kinds").alias("kind")))).filter(kinds).drop("kind")

    stored = rows(keys, "kind < 2")
    least = stored.groupBy("key").agg(F.min(F.struct("id", "shown")).alias("l")).select("key", "l.*")
    star = stored.alias("a").join(least.alias("b"), F.expr(f"a.key = b.key and a.id > b.id and {near('a', 'b')}"))
    close = written(star.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "simhash-near")
    star = written(verify(close), "simhash-stars")
    if within:
        inner = within(close, star)
    labels = connected(close if within else star, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("label"))
    labelled = written(keys.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "simhash-labelled")
    remove(spark, keys)
    a, b = rows(labelled, "kind > 0").alias("a"), rows(labelled, "kind < 2").alias("b")
    far = a.join(b, F.expr(f"a.key = b.key and a.id < b.id and a.label <> b.label and {near('a', 'b')}"))
    far = written(far.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "simhash-far")
    remove(spark, labelled)
    return star.union(inner).union(verify(far)) if within else star.union(verify(far))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, lanes: int = LANES, max_distance: int = CHECKED, parts: int = PARTS, guaranteed: int = GUARANTEED,
    similarity: tuple[int, int] | None = SIMILARITY, extra: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each row of `df`: doc_id, the `extra` columns, the fingerprint's lanes, `component_id`, the smallest doc_id reachable, and
    `group_no`, which numbers the components whether they have a doc_id or not.

    Each fingerprint asks for those of greater id only; as any pair within reach of the thresholds is within reach of either's keys, none is lost.
    """
    names, exact = lanes_of(lanes + (similarity is not None)), similarity is not None
    texts = df.select(F.col(text).alias("_text"))
    fields = [F.col(doc_id).cast("long").alias("_doc"), *extra, F.col(text).alias("_text"), *(_text_ids(text) if exact else [])]
    made = fingerprints(df.select(*fields), "_text", words, len(names), distinct=exact)
    # What tells fingerprints apart: their bits, or of many lanes 128 bits of hash.
    by = ["_p0", "_p1"] if len(names) > 2 else names
    made = made.withColumns({"_p0": F.xxhash64(*names), "_p1": F.xxhash64(F.lit(1), *reversed(names))}) if by != names else made
    slim = written(made, "simhash-docs")
    own = slim.groupBy(*by).agg(F.min("_doc").alias("least"), *(F.any_value(c).alias(c) for c in names if by != names), *([F.min(F.struct("_t0", "_t1")).alias("rep")] if exact else []))
    prints = written(own.withColumns({"id": F.monotonically_increasing_id(), "shown": F.col(names[-1])}), "simhash-prints")
    verify = (lambda pairs: _similar(pairs, prints, texts, words, similarity)) if exact else None
    within = (lambda near, star: _within(prints, texts, near, star, words, similarity)) if exact else None
    found = written(links(prints, lanes, max_distance, parts, guaranteed, verify, within).distinct(), "simhash-links")
    reached = connected(found, "a", "b").withColumnRenamed("node", "id")
    named = prints.select(*by, "id", "least").join(reached, "id", "left").select(*by, "least", F.coalesce("component", "id").alias("group_no"))
    named = written(named, "simhash-groups")
    ids = named.groupBy("group_no").agg(F.min("least").alias("component_id"))
    return slim.drop("_t0", "_t1").join(named.drop("least").join(ids, "group_no"), by).withColumnRenamed("_doc", doc_id)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs, words=3, lanes=1, max_distance=3, parts=3, guaranteed=3, similarity=None)
    return out.select("doc_id", F.lpad(F.lower(F.hex("_w0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
