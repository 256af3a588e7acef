"""Near copies by many-laned fingerprints, against all pairs."""

import numpy as np

from sealgrove.llm import simhash


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def edited(rng, own, n, tag):
    t = list(own)
    for at in rng.choice(len(t), n, replace=False):
        t[at] = f"{tag}{at}"
    return t


def test_pairs_alone_are_found_and_verified(spark):
    """No third text links these pairs: a pair counts if its own texts meet."""
    rng = np.random.default_rng(4)
    rows, similarity = [], {}
    for k in range(600):
        own = [f"p{k}w{x}" for x in range(300)]
        t = edited(rng, own, int(rng.integers(1, 9)), f"p{k}x")
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(t))]
        similarity[k] = jaccard(shingles(own), shingles(t))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = {k: got[2 * k + 1] == 2 * k for k in similarity}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in similarity)
    assert not any(joined[k] for k, j in similarity.items() if j < 0.8)
    close = [joined[k] for k, j in similarity.items() if 0.8 <= j < 0.85]
    rest = [joined[k] for k, j in similarity.items() if j >= 0.85]
    print("share found at 0.80-0.85:", np.mean(close), "of", len(close), "and above:", np.mean(rest), "of", len(rest))
    assert np.mean(close) > 0.9 and np.mean(rest) > 0.98


def test_groups_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):
        own = [f"w{x}" for x in rng.integers(5000, size=int(rng.integers(100, 400)))]
        texts.append(own)
        texts += [edited(rng, own, int(len(own) * rng.uniform(0.002, 0.035)) + 1, f"x{rng.integers(10**6)}y") for _ in range(4 if k else 60)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    want = list(range(len(texts)))
    for _ in range(20):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[i] == want[i] for i in range(len(want))]) > 0.98
    assert all(got[i] >= want[i] for i in range(len(want)))  # nothing is joined that isn't similar


def test_majority_counts_long_runs():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 255, 256, 700, 3])
    h = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, sizes.sum(), dtype=np.uint64)
    at, want = 0, []
    for n in sizes:
        bits = np.unpackbits(h[at : at + n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        want.append(int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0]))
        at += n
    assert simhash._majority(h, sizes).tolist() == want


def test_ids_of_any_size(spark):
    big = (1 << 63) - 1
    rows = [(big, "one two three four five six"), (big - 1, "one two three four five six"), (-(1 << 63), "seven of nine"), (None, "alone and without a number"), (1 << 62, "alone")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {big: big - 1, big - 1: big - 1, -(1 << 63): -(1 << 63), None: None, 1 << 62: 1 << 62}


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y")], "doc_id long, text string, key string")
    out = simhash.near_duplicates(df, extra=("key",))
    assert sorted((r["doc_id"], r["key"], r["component_id"]) for r in out.collect()) == [(1, "x", 1), (2, "y", 1)]
