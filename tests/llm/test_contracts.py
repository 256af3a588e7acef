"""Every operator's query against SQL or brute force, on whole small tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from sealgrove.llm import bpe, langid, lines, media, mixing, quality, sharding, simhash, substrings, topk

WITH_SQL = {**lines.ORACLES, **mixing.ORACLES, **sharding.ORACLES, **topk.ORACLES}
QUERIES = {**lines.QUERIES, **mixing.QUERIES, **sharding.QUERIES, **topk.QUERIES}


@pytest.mark.parametrize("name", sorted(WITH_SQL))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    cursor = duck.execute(WITH_SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted(repr([r[i] for i in order]) for r in cursor.fetchall())


def documents(duck):
    return duck.execute("select doc_id, text, lang from documents order by doc_id").fetchall()


def test_simhash_against_brute_force(spark, duck, sf):
    import xxhash

    prints = {}
    for i, text, _ in documents(duck):
        w = text.encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {(i, f"{p:016x}", find(i)) for i, p in prints.items()}
    assert {tuple(r) for r in simhash.op1_simhash(spark, sf).collect()} == want


def test_media_reads_back_what_it_stores(spark, duck, sf):
    got = {r["doc_id"]: r for r in media.op2_media(spark, sf).collect()}
    docs = documents(duck)
    assert len(got) == len(docs)
    for i, text, _ in docs:
        raw = text.encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_langid_on_held_out_documents(spark, duck, sf):
    truth = {i: lang for i, _, lang in documents(duck)}
    rows = langid.op3_langid(spark, "/root/testdata/sf0.01").collect()
    truth = dict(duck.execute("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_quality_on_held_out_documents(spark, duck):
    truth = dict(duck.execute("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = quality.op9_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]) > 0.95


NO_ID = 1 << 70  # greater than any


def brute_repeats(rows, window=50):
    first, out = {}, collections.defaultdict(list)
    for i, t in rows:
        for p in range(len(t) - window + 1):
            k = t[p : p + window]
            first[k] = min(first.get(k, 1 << 71), i)
    for i, t in rows:
        covered = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < i:
                covered[p : p + window] = b"\1" * window
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        spans = sum(1 for j in range(len(t)) if covered[j] and (j == 0 or not covered[j - 1]))
        out[i].append((len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def repeats(df, **options):
    from pyspark.sql import functions as F

    out = collections.defaultdict(list)
    for r in substrings.drop_repeats(df, **options).withColumn("h", F.sha2("kept", 256)).collect():
        out[NO_ID if r["doc_id"] is None else r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]))
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])
    return {k: sorted(v) for k, v in out.items()}


def test_substrings_against_brute_force(spark, duck, sf):
    docs = [(i, t.encode()) for i, t, _ in documents(duck)]
    got = collections.defaultdict(list)
    for r in substrings.op5_substrings(spark, sf).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert dict(got) == brute_repeats(docs)


def test_substrings_of_pieces_and_periods(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcde "), 3000))
    rows = []
    for i in range(50):
        t = ""
        while len(t) < rng.integers(900):
            a = int(rng.integers(2900))
            t += base[a : a + int(rng.integers(1, 120))]
        t += "ab" * int(rng.integers(200)) * (i % 7 == 0) + "\0" * 70 * (i % 9 == 0) + "é" * 60 * (i % 5 == 0)
        rows.append(([i, (1 << 63) - 1 - i % 3, 3, None, -i][int(rng.integers(5))], t if i % 13 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_repeats([(NO_ID if i is None else i, (t or "").encode()) for i, t in rows])
    assert repeats(df) == want
    assert repeats(df, part_bytes=0, group=1) == want  # every shard recurses, and every group is split down to its windows
    assert repeats(df, part_bytes=600, group=40) == want  # some do


def test_substrings_of_one_passage_in_all_documents(spark):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh"), 70))
    rows = [(i, "".join(rng.choice(list("xyz "), 60)) + passage + "".join(rng.choice(list("xyz "), 60))) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(200)]  # copies, which share their whole blocks
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    assert repeats(df, part_bytes=0, group=7) == want
    assert repeats(df) == want


def test_bpe_equals_the_library(spark, duck, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.op10_bpe(spark, sf).collect()}
    for i, text, _ in documents(duck):
        ids = t.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        want = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i])[1:] == want


def test_bpe_on_odd_characters():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.Bpe(bpe.vocabulary())
    random.seed(1)
    pieces = [*"aaab tT'sn 're\n\t\r\x0b\x0c\x1c\x1d\x1f\x85\xa0　 ​᠎12٣½éñ中😀!?.,Ⅷ", "<|endoftext|>", " the", "ing", "a" * 50]
    for _ in range(3000):
        s = "".join(random.choice(pieces) for _ in range(random.randint(0, 30)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(own.encode([s])[0], dtype="<u4").tolist() == ids
        assert own.decode(np.array(ids, dtype="<u4").tobytes()) == t.decode(ids, skip_special_tokens=False)


def test_topk_with_ties_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4), (450, [float("inf")] * 4), (None, [1.0] * 4), (500, []), (550, [0.5, 0.25]), (7, [1.0] * 4)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    own = {}
    valid = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (4 - len(v))) for i, v in rows if i is not None and v is not None and None not in v and all(np.isfinite(v))]
    for i, v in valid:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in valid if j != i)
            own[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(scored[:5])]
    got = collections.defaultdict(list)
    for r in topk.top_k(vectors, vectors.filter("id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert dict(got) == own


def test_topk_with_few_candidates_and_none(spark):
    few = topk.quantised(spark.createDataFrame([(0, [1.0]), (50, [1e30]), (51, [2.0])], "vec_id long, embedding array<double>"))
    assert topk.top_k(few, few.filter("id % 50 = 0"), 5).count() == 4
    assert topk.top_k(few.limit(0), few.limit(0), 5).count() == 0


def test_topk_over_many_groups_of_blocks(spark, monkeypatch):
    """Blocks of a few rows, so that histograms come from many groups; scores with an outlier, and many that are equal."""
    for name, size in (("QUERY_BLOCK", 4), ("CANDIDATE_BLOCK", 8), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(5)
    vs = [(i, [int(x) for x in rng.integers(-3, 4, 3)]) for i in range(300)] + [(1000, [10**6, 0, 0]), (1001, [0, 0, 0])] + [(2000 + i, [1, 1, 1]) for i in range(30)]
    df = spark.createDataFrame(vs, "id long, v array<long>").repartition(5)
    got = {}
    for r in topk.top_k(df, df.filter("id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, a in vs:
        if q % 10 == 0:
            best = sorted(((i, sum(x * y for x, y in zip(a, b, strict=True))) for i, b in vs if i != q), key=lambda x: (-x[1], x[0]))[:5]
            assert got.pop(q) == best
    assert not got


def test_topk_of_scores_up_to_63_bits(spark):
    big = 3 * 10**9 + 1
    df = spark.createDataFrame([(0, [big]), (1, [big - 1]), (2, [-big]), (3, [1]), (50, [-big])], "id long, v array<long>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, big * (big - 1)), (0, 3, big), (50, 2, big * big), (50, 3, -big)]
