"""The operators' own parts: pigeonhole thresholds, FLAC, splitting tree, hash tree, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealgrove.llm import flac, langid, mixing, sharding, simhash
from sealgrove.llm.components import connected


def test_thresholds_lose_no_pair():
    rng = np.random.default_rng(1)
    n, widths = 400, [22, 21, 21]
    base = rng.integers(0, 2, (n, 64)).astype(np.uint8)
    base[100:] = base[:1]
    flips = rng.integers(0, 64, (300, 3))
    for i, f in enumerate(flips):
        base[100 + i, f] ^= 1
    joint = base.astype(np.int64).T @ base
    groups = simhash.group_bits(joint, n, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and [len(g) for g in groups] == widths
    halves = simhash._halves(groups)
    shares = []
    for h in halves:
        v = simhash._project(base, h)
        shares.append(simhash.near_shares(np.bincount(v, minlength=1 << len(h)))[v])
    t = simhash.allocate(list(zip(shares[::2], shares[1::2], strict=True)), widths, n, 3)
    assert (t.sum(axis=1) + 3 == 4).all() and (t >= -1).all()
    for i in range(n):
        for j in range(n):
            if (base[i] != base[j]).sum() <= 3:
                apart = [int((base[i][g] != base[j][g]).sum()) for g in groups]
                assert any(d <= k for d, k in zip(apart, t[i], strict=True))


@pytest.mark.parametrize("size", [64, 128, 1024, 1088, 5000 * 64])
def test_flac_round_trip(size):
    rng = np.random.default_rng(size)
    kinds = [rng.integers(0, 256, size), np.zeros(size), np.full(size, 255), rng.integers(97, 123, size), np.arange(size) % 256, 128 + 100 * np.sin(np.arange(size) / 9)]
    spikes = np.zeros(size)
    spikes[size // 2] = 255
    payloads = [k.astype(np.uint8).tobytes() for k in [*kinds, spikes]]
    streams = flac.encode_streams(payloads)
    for (x, blocks, bps), p in zip(flac.decode_streams(streams), payloads, strict=True):
        assert bps == 8 and (x + 128).astype(np.uint8).tobytes() == p
        assert [b[0] for b in blocks] == list(range(0, size, flac.BLOCK))
    assert len(streams[1]) < len(payloads[1]) or size < 256


def test_flac_finds_every_damaged_bit():
    random.seed(4)
    s = flac.encode_streams([b"the cat sat on the mat and was there. " * 32])[0]
    for _ in range(80):
        d = bytearray(s)
        d[random.randrange(8 + 34 + 22, len(s))] ^= 1 << random.randrange(8)
        with pytest.raises(flac.Damaged):
            flac.decode_streams([bytes(d)])


def test_flac_without_seek_table():
    p = b"".join(bytes([97 + i * i % 26]) for i in range(64 * 100))
    s = flac.encode_streams([p])[0]
    table = int.from_bytes(s[43:46], "big")
    assert (flac.decode_streams([b"fLaC\x80" + s[5:42] + s[46 + table :]])[0][0] + 128).astype(np.uint8).tobytes() == p


def test_splitting_tree_deals_exact_quotas():
    quotas = np.array([1000, 3, 0, 517])
    leaves = mixing.split_quotas(quotas, 7, 1)
    assert leaves.shape == (7, 4) and (leaves >= 0).all() and (leaves.sum(axis=0) == quotas).all()
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 3
    assert (leaves == mixing.split_quotas(quotas, 7, 1)).all()


def test_targets_stop_at_the_cap_and_share_everything():
    sizes = [10, 1000, 1000, 0, 5]
    t = mixing.targets(sizes)
    assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_a_new_shard_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select(sharding.shard_of(F.col("id"), sharding.EIGHT).alias("a"), sharding.shard_of(F.col("id"), sharding.NINE).alias("b"))
    assert df.filter("a <> b and b <> 8").count() == 0
    assert abs(df.filter("b = 8").count() - 20000 / 9) < 250
    assert all(abs(r["count"] - 2500) < 250 for r in df.groupBy("a").count().collect())


def test_movement_stays_in_the_subtree_whose_weights_change(spark):
    from pyspark.sql import functions as F

    before = sharding.EIGHT
    after = tuple(sharding.Leaf(x.region, x.rack, x.shard, {0: 0.5, 1: 1.5}.get(x.shard, 1.0)) for x in before)
    df = spark.range(5000).select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b"))
    moved = df.filter("a <> b")
    assert moved.count() > 0 and moved.filter("a not in (0, 1) or b not in (0, 1)").count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (52, 52)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}, 50: 50, 51: 50, 52: 50}
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_filter_returns_all_languages_of_a_gram():
    f = langid.Filter({"en": langid.grams("the and of"), "de": langid.grams("the und der")})
    assert f.langs == ["de", "en"]
    assert (f.languages(langid.grams("the")) == 3).all() and f.languages(langid.grams("the")).shape[1] == 1
    assert f.decide(None) == ("und", 0.0) and f.decide("123 ...") == ("und", 0.0) and f.decide("der und")[0] == "de"


def test_mix_takes_what_the_leaves_say(spark):
    """The shards that documents get, against the tree: a source's draws of a shard are its leaf, which the documents' shards are counted back to by block."""
    rows = [(i, "ab"[i % 7 == 0], f"w{i} " * (i % 5 + 1)) for i in range(400)] + [(900, None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.mix_plan(docs, shards=5)
    place = mixing.position(F.col("doc_id"), F.col("text"), str(mixing.SEED))
    mixed = mixing.mixed(docs, plan, "source", place).withColumn("place", place).collect()
    for p in plan.collect():
        ends, own = p["_ends"], [r for r in mixed if r["source"] == p["_source"]]
        assert len(ends) == 5 and list(ends) == sorted(ends)
        for r in own:
            block, last = r["place"] >> (mixing.HASH_BITS - mixing.BLOCK_BITS), ends[-1] - 1 if p["_cut"] >= 0 else ends[-1]
            draws = [c * mixing.BLOCKS + block for c in range(mixing.CAP + 1)]
            draws = [d for d in draws if d < last or (p["_cut"] >= 0 and d == last and r["place"] <= p["_cut"])]
            assert r["shards"] == [next(k for k, e in enumerate(ends) if d < e) for d in draws]
        assert {k for r in own for k in r["shards"]} <= set(range(5)) and sum(len(r["shards"]) for r in own) > 0
    got = [(r["doc_id"], r["shard"]) for r in mixing.mix_sources(docs, shards=5).collect()]
    assert sorted(got) == sorted((r["doc_id"], k) for r in mixed for k in r["shards"])
