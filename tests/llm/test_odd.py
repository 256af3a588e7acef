"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sealgrove.llm import bpe, langid, lines, media, mixing, quality, sharding, simhash, substrings
from tests.llm.odd import CLASHES, SCHEMA, odd_documents, odd_rows, write_tables

QUERIES = {**bpe.QUERIES, **langid.QUERIES, **lines.QUERIES, **media.QUERIES, **mixing.QUERIES, **quality.QUERIES, **sharding.QUERIES, **simhash.QUERIES, **substrings.QUERIES}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (3, None, None), (6, 0, 1), (-5, 1, 0)], "doc_id long, quality int, toxic int")
    full = write_tables(odd_documents(spark, clashes=True), tmp_path_factory.mktemp("odd"), labels)
    empty = write_tables(odd_documents(spark, rows=[]), tmp_path_factory.mktemp("empty"), labels.limit(0))
    return full, empty


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd[0]).collect()
    assert len(rows) == len(odd_rows())
    assert QUERIES[name](spark, odd[1]).count() == 0


def test_defined_results(spark, odd):
    of = lambda name, i: [r for r in QUERIES[name](spark, odd[0]).collect() if r["doc_id"] == i]
    assert [(r["n_tokens"]) for r in of("op10_bpe", 3) + of("op10_bpe", 4)] == [0, 0]
    assert {(r["lang_pred"], r["score"]) for i in (3, 4, 8, 9) for r in of("op3_langid", i)} == {("und", 0.0)}
    assert {r["fingerprint"] for i in (3, 4, 5, 8) for r in of("op1_simhash", i)} == {"0" * 16}
    assert {r["component_id"] for i in (1, 2) for r in of("op1_simhash", i)} == {1}
    assert {(r["n_bytes"], r["payload_bytes"]) for i in (3, 4, 5) for r in of("op2_media", i)} == {(0, 64)}
    assert {(r["size"], r["text_crc32"]) for i in (3, 4) for r in of("op8_sharding", i)} == {(1, 0)}
    assert {(r["n_lines"], r["kept_sha256"] is None) for r in of("op6_line_dedup", 4)} == {(0, True)}
    assert {r["size"] for r in of("op4_mixing", 4)} == {0}
    slots = {}
    for r in QUERIES["op8_sharding"](spark, odd[0]).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_boilerplate_is_relative_to_the_host(spark):
    rows = [(i, f"Menu \nown line {i}\n\n", "a") for i in range(10)] + [(10 + i, f"Menu\nline {i}" if i < 5 else f"line {i}", "b") for i in range(60)] + [(99, "Menu\nMenu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(df, counts=True).collect()}
    assert got[3]["text"] == "own line 3\n\n" and got[3]["n_dropped"] == 1
    assert got[11]["text"] == "Menu\nline 1"  # 5 of 60 pages are less than a tenth
    assert got[99]["text"] == "Menu\nMenu"


def test_operators_carry_columns_of_any_name(spark):
    df = odd_documents(spark, clashes=True)
    own = {"shard", "slot", "grown_shard"}
    out = sharding.shard_rows(df, "doc_id", sharding.EIGHT, sharding.NINE)
    assert set(out.columns) == set(df.columns) and out.filter("_h = 'own _h' and _bucket = 'own _bucket'").count() == out.count()
    assert {c for c, t in out.dtypes if c in own and t != "string"} == own
    for out in (lines.drop_boilerplate(df), mixing.mix_sources(df), langid.predict(df, langid.Filter({})), bpe.encode(df)):
        assert set(df.columns) <= set(out.columns) and out.filter("a <> 'own a' or _key <> 'own _key'").count() == 0


@pytest.mark.parametrize("clashes", [False, True])
def test_pipeline_stages_take_odd_documents(spark, odd, clashes):
    docs = odd_documents(spark, clashes)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd[0])
        if name != "bpe_encoding":
            assert out.columns == docs.columns
            if clashes:
                assert out.filter(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASHES)).count() == 0
            docs = spark.createDataFrame(out.collect(), out.schema)
    rows = out.collect()
    assert all(r["same_text"] for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), odd[1]).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (9, " ".join(words)), (None, " ".join(words)), (None, "all of it alone"), (None, "all of it alone"), (7, " ".join(reversed(words)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = [(r["doc_id"], r["text"][:3]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(3, "w0 "), (7, rows[-1][1][:3]), (None, "all")], key=str)


def test_pipeline_runs_on_the_small_table(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.filter(~F.col("same_text")).count() == 0
