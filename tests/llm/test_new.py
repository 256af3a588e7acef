"""Hard negatives, token counts and phrases against brute force and the library."""

import random
from collections import Counter

import numpy as np
import pytest

from sealgrove.llm import negatives, phrases, tokens

EMBEDDINGS = "vec_id long, embedding array<double>, label int"


def mined(rows, every=50, positives=5, share=3):
    """The contract by plain loops over (id, label, vector) rows of integers."""
    out = []
    for a in rows:
        if a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in rows if b[0] != a[0]), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            found = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:share]
            out += [(a[0], p, k, x[1], -s, -x[0]) for k, x in enumerate(found, 1)]
    return sorted(out)


def as_rows(spark, df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["clusters", "ties", "wide"])
def test_negatives_against_all_pairs(spark, kind):
    rng = np.random.default_rng(5)
    n, dim = (700, 12) if kind != "ties" else (300, 3)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dim) * 0.7
        v = np.rint(v) / 256 if kind == "ties" else v * (1e6 if kind == "wide" else 0.3)
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4))))
    df = negatives.labelled(spark.createDataFrame(rows, EMBEDDINGS).repartition(5))
    plain = [(r["id"], r["label"], r["v"]) for r in df.collect()]
    want = mined(plain)
    assert want and as_rows(spark, negatives.hard_negatives(df, df.filter("id % 50 = 0"))) == want
    small = negatives.fitted(df, 3)  # the sample decides how many rows are scored exactly, not what comes out
    assert as_rows(spark, negatives.hard_negatives(df, df.filter("id % 50 = 0"), book=small)) == want


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(2)
    c, a = (np.rint(rng.normal(size=(k, 17)) * 90).astype(np.int64) for k in (500, 30))
    book = negatives.Codebook(c[:20])
    pack = lambda m: (np.arange(len(m)), np.zeros(len(m), np.int64), m, *book.encode(m))
    b = negatives.Bounds(book, pack(a), pack(c))
    exact = c @ a.T
    for q, k, lower, upper in b.tiles():
        assert (lower <= exact[k, q]).all() and (exact[k, q] <= upper).all()
    close = negatives.Bounds(book := negatives.Codebook(c), (np.arange(30), np.zeros(30, np.int64), a, *book.encode(a)), (np.arange(500), np.zeros(500, np.int64), c, *book.encode(c)))
    assert all((upper - lower).mean() < exact.std() for _, _, lower, upper in close.tiles())


def test_scored_pairs_of_a_task_are_not_all_held(monkeypatch):
    monkeypatch.setattr(negatives, "MOST_PAIRS", 100)
    rng, firsts, every = np.random.default_rng(3), negatives.Firsts(2), []
    for _ in range(200):
        part = rng.integers(0, 7, 50), rng.integers(0, 1000, 50), rng.integers(0, 30, 50)
        firsts.add(*part)
        every += zip(*(x.tolist() for x in part), strict=True)
        assert sum(len(x[0]) for x in firsts.held) <= 164
    want = [x for q in range(7) for x in sorted((x for x in every if x[0] == q), key=lambda x: (-x[2], x[1]))[:2]]
    assert list(zip(*(x.tolist() for x in firsts.first()), strict=True)) == want
    assert negatives.BLOCK * 64 * 8 < 1 << 20  # a writer of Parquet holds a hundred rows before it looks at their size


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.2], 2), (3, [0.8], 2), (3, [0.8], 2), (4, [nan, 1.0], 2), (5, [inf], 2), (6, [None, 0.8], 2), (7, None, 2), (None, [0.8, 0.0], 2),
        (8, [0.8, 0.0], None), (50, [-1.0, 0.0], 3), (51, [1.0, 0.0], 3), (100, [], 4), (101, [1.0, 1.0], 4), (0, [1.0, 0.5], 9),
    ]
    df = negatives.labelled(spark.createDataFrame(rows, EMBEDDINGS).withColumnRenamed("embedding", "block"), embedding="block")
    got = as_rows(spark, negatives.hard_negatives(df, df.filter("id % 50 = 0")))
    # 0 asks once, with its smallest label; 3 is there twice; 50 has only a positive of negative score; all scores of the empty vector are 0, and so is its window.
    assert [x for x in got if x[0] == 0] == [(0, 1, 1, 3, 230 * 256, 204 * 256), (0, 1, 2, 3, 230 * 256, 204 * 256), (0, 1, 3, 2, 230 * 256, 179 * 256)]
    assert [x for x in got if x[0] == 50] == []
    assert [x[2:] for x in got if x[0] == 100] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0)]
    assert negatives.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert negatives.hard_negatives(df, df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.vocabulary())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


ODD = [
    "", " ", "   a", "a   b    c ", "\n\n a\t b\r\n", "<s>x</s><unk><0x0A>", "▁▁ a ▁", "\x00é日本語 🙂🙂", "a" * 500, " " * 300 + "x", "the " * 50, "ａｂｃ   x", "word" * 200 + " ", "▁" * 40,
    "don't e.g. 1,250.00 (see [12])", "ABC" * 30 + "1" * 100, "ﬁ ſ İ ß", "é ​ ﻿", "x " * 70_000,
]


def test_counts_equal_the_library(counter, library):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("ab the \n\t▁.,;)(*-1é日Жж  ") for _ in range(rng.randint(1, 200))) for _ in range(1500))]
    texts += ["".join(rng.choice(tuple(counter.symbol)).replace("▁", " ") for _ in range(30)) for _ in range(1000)]
    assert counter.count(texts) == [len(x) for x in library.encode(texts)]
    counter.forget()
    assert counter.count(texts[:5]) == [len(x) for x in library.encode(texts[:5])]


def test_whole_strings_are_proved(counter):
    """Every string taken as one token is what exact merging of it gives, in step and with a heap."""
    some = list(counter.whole)[::97]
    assert all(n == 1 for n in counter.merged(some)) and all(counter._heap(w) == 1 for w in some)
    rest = ["▁qzxv", "zzzzqq", "▁" * 37, "▁Donaudampfschiff", "日本"]
    assert counter.merged(rest) == [counter._heap(w) for w in rest] and not set(rest) & set(counter.whole)


def test_a_vocabulary_across_spaces_is_not_cut():
    """Strings with a space inside: only the whole text is a pre-token. Equal scores merge from the left."""
    c = tokens.Counter([("a", 0.0), ("b", 0.0), ("▁", 0.0), ("b▁", -1.0), ("b▁a", -2.0), ("aa", -3.0), ("bb", -3.0)])
    assert c.count(["ab ab", "aaa", "bb", ""]) == [4, 3, 2, 0]  # ▁ a b▁a b; ▁ aa a; ▁ bb


def test_token_counts_of_a_table(spark, sf, library):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(-1, None), (None, ""), (-2, "one two"), (-2, "one two")], "doc_id long, text string"))
    clash = df.selectExpr("doc_id", "text", "'x' as N_TOKENS", "1 as _text")
    got = tokens.with_token_counts(clash, counter=tokens.Counter(tokens.vocabulary()))
    assert got.columns == ["doc_id", "text", "_text", "n_tokens"]
    for r in got.collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or ""))
    out = tokens.op12_tokens(spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in out.collect())


def collocated(rows, longest=3, least=10, cover=50, top=2000):
    """The contract by plain loops."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                gone |= {q for i in range(len(p) - k + 1) if 100 * a >= cover * cands[q := p[i : i + k]]}
        rows_ = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        out += [(lang, i, p.decode(), a, left, right, n[lang], score) for i, (_, _, p, a, left, right, score) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_against_loops(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "The", "of", "new", "york", "city", "é", "日本", "\x0e", "\x00a", "a\xa0b", "x_y", "ÀB", "àb", "İ"]
    texts = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?", "\x0b", ""]) for _ in range(rng.randint(0, 60)))) for _ in range(400)]
    texts += [("en", "new york city " * 200), ("en", "of " * 300), ("en", None), ("en", ""), ("fr", "!?. \t"), (None, "lone")]
    df = spark.createDataFrame(texts, "lang string, text string")
    want = collocated(texts)
    assert len(want) > 100
    assert phrase_rows(phrases.collocations(df.repartition(7))) == want
    assert phrase_rows(phrases.collocations(df, longest=4, min_count=3, cover=70, top=20)) == collocated(texts, 4, 3, 70, 20)
    assert phrase_rows(phrases.collocations(df, min_count=40)) == collocated(texts, least=40)  # above what a counter holds
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.selectExpr("lang", "text", "1 as k", "2 as phrase", "3 as n")).count() == len(want)


def test_shards_and_sketch_admit_all_frequent_phrases(monkeypatch):
    """Small shards and a sketch of few counters, which lets much pass by mistake, lose nothing."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(40)) for _ in range(200)]
    monkeypatch.setattr(phrases, "SHARD", 2000)
    monkeypatch.setattr(phrases, "HASHED", 64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 100 + ["de"] * 100, "text": texts})
    shards = list(phrases._shards(iter([batch])))
    assert len(shards) > 4 and sum(len(s.word) for _, s in shards) == 200 * 40
    cells = np.zeros(phrases.CELLS, dtype=np.int64)
    for lang, s in shards:
        for _, h in s.phrases(3, lang):
            np.add.at(cells, h >> np.uint64(64 - (phrases.CELLS.bit_length() - 1)), 1)
    total = (np.minimum(cells[::2], 15) << 4 | np.minimum(cells[1::2], 15)).astype(np.uint8)
    found = Counter()
    for lang, s in shards:
        for _, p, n in zip(*phrases._counted(s, phrases._admitted(total, s, 3, lang, 10)), strict=True):
            found[lang, p.strip()] += n
    plain = Counter((lang, " ".join(t.split()[i : i + k])) for lang, t in zip(batch.column(0).to_pylist(), texts, strict=True) for k in (1, 2, 3) for i in range(len(t.split()) - k + 1))
    assert {k: n for k, n in found.items() if n >= 10} == {k: n for k, n in plain.items() if n >= 10}


def test_automata_of_a_shard_with_many_phrases_are_several(monkeypatch):
    rng = np.random.default_rng(5)
    shard = phrases.Shard([phrases.normal(" ".join(f"w{x}" for x in rng.integers(0, 9, 40)) + ". A b") for _ in range(30)])
    admitted = phrases._admitted(np.full(phrases.CELLS // 2, 0xFF, np.uint8), shard, 3, "en", 10)
    rows = lambda: [sorted(zip(*phrases._counted(shard, part), strict=True)) for part in phrases._dealt(shard, admitted)]
    whole = rows()
    monkeypatch.setattr(phrases, "PLACES", 200)
    parts = rows()
    assert len(whole) == 1 and len(parts) > 8 and max(map(len, parts)) < len(whole[0]) / 4
    assert sorted(x for p in parts for x in p) == sorted(x for p in whole for x in p)
