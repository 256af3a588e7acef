"""Every registered query outside the training-data operators against its SQL, and worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from sealgrove.functions import codes, dates
from sealgrove.operators import entities, spans
from sealgrove.operators.recognizers import BY_NAME, inclusion_rule, mentions, plugged_in
from sealgrove.plans import registry

QUERIES = {k: v for m in registry.MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in registry.MODULES for k, v in m.ORACLES.items()}
NOTE = "Wiremu attended his session with sister Margaret and friend Aroha.\nContact: 021-555-1234\nNHI: ABC1234\nAddress: 45 High Street, Otahuhu\nDate: 15/03/2024"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in cursor.fetchall())


@pytest.fixture
def note(spark):
    return spark.createDataFrame([("s", 1, 1, NOTE)], "session_id string, doc_id long, doc_seq int, text string")


def test_the_worked_note(note):
    found = {(r["text"], r["s"], r["e"]) for r in mentions(note).collect()}
    assert {("021-555-1234", 76, 88), ("ABC1234", 94, 101), ("45 High Street", 111, 125), ("Otahuhu", 127, 134), ("15/03/2024", 141, 151), ("Wiremu", 0, 6), ("Margaret", 40, 48), ("Aroha", 60, 65)} <= found
    out, own = entities.redact_documents(note)
    assert out.first()["redacted"] == "[PERSON_A] attended his session with sister [PERSON_B] and friend [PERSON_C].\nContact: [CONTACT_A]\nNHI: [ID_A]\nAddress: [LOCATION_A], [LOCATION_B]\nDate: [DATE_A] 2024"
    assert out.first()["n_entities"] == 8
    assert entities.restore(out, own).first()["restored"] == NOTE


def test_odd_texts(spark):
    rows = [("s", 1, 1, None), ("s", 2, 2, ""), ("s", 3, 3, "  \n"), ("s", 4, 4, "\U0001f600 mail a@b.nz $1 \\2 a@b.nz"), (None, 5, 5, "a@b.nz")]
    docs = spark.createDataFrame(rows, "session_id string, doc_id long, doc_seq int, text string")
    out = {r["doc_id"]: r["redacted"] for r in entities.redact_documents(docs)[0].collect()}
    assert out[1] is None and out[2] == "" and out[3] == "  \n"
    assert out[4] == "\U0001f600 mail [CONTACT_A] $1 \\2 [CONTACT_A]"
    assert entities.redact_documents(docs.limit(0))[0].count() == 0


def test_letters(spark):
    rows = spark.range(18278).select(codes.letters(F.col("id")).alias("x")).collect()
    assert [rows[i]["x"] for i in (0, 25, 26, 27, 701, 702, 18277)] == ["A", "Z", "AA", "AB", "ZZ", "AAA", "ZZZ"]
    assert len({r["x"] for r in rows}) == 18278


def test_letters_take_any_number_or_raise(spark):
    def name(n):
        out = ""
        n += 1
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(65 + k) + out
        return out

    ns = [18277, 18278, 475253, 475254, 475255, 12356629, 12356630, 321272405, 321272406, 2**31 - 1]
    for kind in ("int", "long"):
        df = spark.createDataFrame([(n,) for n in ns], f"n {kind}")
        assert [r["x"] for r in df.select(codes.letters(F.col("n")).alias("x")).collect()] == [name(n) for n in ns]
    assert spark.sql("select cast(null as int) as n").select(codes.letters(F.col("n"))).first()[0] is None
    for n in (-1, sum(26**k for k in range(1, 8))):
        with pytest.raises(Exception, match="no letters for"):
            spark.createDataFrame([(n,)], "n long").select(codes.letters(F.col("n"))).collect()


def test_dates(spark):
    text = "Patient visited on 12 January 2024. Follow-up scheduled for January 15, 2024. Previous appointment was 2023-12-01."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert dates.with_normal_dates(docs).first()["normalized"] == "Patient visited on 12/01/2024. Follow-up scheduled for 15/01/2024. Previous appointment was 01/12/2023."


def test_spans_are_apart_and_sorted(spark, sf):
    kept = QUERIES["overlap_greedy"](spark, sf).orderBy("doc_id", "s").collect()
    assert kept and all(a["doc_id"] != b["doc_id"] or a["e"] <= b["s"] for a, b in zip(kept, kept[1:], strict=False))


def test_recognizers_can_be_plugged_in(spark):
    docs = spark.createDataFrame([(1, "see Jo at noon"), (2, None)], "doc_id long, text string")
    out = plugged_in(docs, lambda t: [(t.index("Jo"), t.index("Jo") + 2, "Jo", "person_other", 0.9)] if "Jo" in t else [])
    assert [tuple(r)[:4] for r in out.collect()] == [(1, 4, 6, "Jo")]
    assert [r["text"] for r in mentions(docs, (inclusion_rule(["NOON", "jo"]), BY_NAME["email"])).orderBy("s").collect()] == ["Jo", "noon"]


def test_overlap_keeps_the_surer_and_longer(spark):
    rows = [(0, 5, "abcde", "x", 0.7, 1, 0), (3, 9, "defghi", "x", 0.7, 2, 0), (20, 22, "uv", "x", 0.9, 1, 0), (21, 30, "v........", "x", 0.8, 1, 0)]
    m = spark.createDataFrame([(rows,)], "mentions array<struct<s:int,e:int,text:string,type:string,confidence:double,rec_ord:int,pat_ord:int>>")
    assert [(x["s"], x["e"]) for x in m.select(spans.without_overlaps(F.col("mentions")).alias("k")).first()["k"]] == [(3, 9), (20, 22)]
