"""Worked examples and odd cases of de-identification: variants, restoring, replacement by text, control characters, null sessions, streams."""

import re

import time

import pytest
from pyspark.sql import functions as F

from sealgrove.functions.scan import scan
from sealgrove.operators import edits, entities, parts, review
from sealgrove.operators import names as on
from sealgrove.operators.joins import numbered
from sealgrove.operators.recognizers import BY_NAME, Rule, mentions
from sealgrove.streaming.redaction import finished, mask_stream, redact_stream

DOCS = "session_id string, doc_id long, doc_seq long, text string"
ID_AND_NAME = (BY_NAME["title_name"], BY_NAME["known_name"], BY_NAME["relation_word"], BY_NAME["email"], BY_NAME["date_slash"])

# Spans of each recognizer on a text, written by hand: (rule, text, [(start, end)]).
SPANS = [
    ("email", "to a.b@c.co.nz, or x@y", [(3, 14)]), ("phone_mobile", "021-555-1234 and 0215551234 and 0201234567", [(0, 12), (17, 27)]),
    ("phone_landline", "09 555 1234, 02 555 1234", [(0, 11)]), ("phone_international", "+64 21 555 1234.", [(0, 15)]), ("phone_free", "0800 555 123 0800123456", [(0, 12), (13, 23)]),
    ("id_nhi", "NHI ABC1234 abc1234 ABCD1234", [(4, 11)]), ("id_acc", "ACC 12345 ACC1234", [(0, 9)]), ("id_record", "MRN: X0001 case", [(0, 10)]), ("id_dashed", "CR-12345 CR-1234", [(0, 8)]),
    ("id_alnum", "ab12 abcd 1234 a-1b", [(0, 4), (15, 19)]), ("date_slash", "1/2/2020 1/2/20", [(0, 8)]), ("date_iso", "2020-1-31", [(0, 9)]), ("date_month_day", "on May 3, 2020", [(3, 14)]),
    ("date_day_month", "3 May 2020", [(0, 10)]), ("date_day_mon", "3 Jan 2020", [(0, 10)]), ("place_street", "at 45 High Street.", [(3, 17)]), ("place_suburb", "Mt Eden", [(0, 7)]),
    ("place_city", "in Wellington", [(3, 13)]), ("place_hospital", "Middlemore Hospital", [(0, 19)]), ("place_board", "Auckland DHB", [(0, 12)]), ("known_name", "AROHA and Wiremu", [(0, 5), (10, 16)]),
    ("relation_name", "sister Mary Ann came", [(7, 15)]), ("relation_word", "his Uncle Bob", [(10, 13)]), ("title_name", "Dr. Jo Ann Lee Park", [(4, 14)]), ("numbers_joined", "12/3 4 56", [(0, 4), (7, 9)]),
    ("numbers_short", "1/2 and 3-4-5", [(0, 3), (8, 13)]), ("numbers_long", "123 1234", [(4, 8)]),
]


def test_spans_written_by_hand(spark):
    for name, text, spans in SPANS:
        got = sorted((r["s"], r["e"]) for r in mentions(spark.createDataFrame([(1, text)], "doc_id long, text string"), (BY_NAME[name],)).collect())
        assert got == spans, name


def people(spark, texts, rules=ID_AND_NAME):
    docs = spark.createDataFrame([("s", i, i, t) for i, t in enumerate(texts)], DOCS)
    out, codes = entities.redact_documents(docs, rules)
    return docs, out, codes


def test_a_part_of_a_name_shares_its_person(spark):
    _, out, codes = people(spark, ["Dr John Smith saw him. Mr John came, Ms Smith too.", "Mr John and Dr Jo Ann Lee; uncle Jo."])
    got = [r["redacted"] for r in out.orderBy("doc_id").collect()]
    assert got == ["Dr [PERSON_A_FIRST_LAST] saw him. Mr [PERSON_A_FIRST] came, Ms [PERSON_A_LAST] too.", "Mr [PERSON_A_FIRST] and Dr [PERSON_B_FULL]; uncle [PERSON_B_FIRST]."]
    rows = {r["code"]: r["original"] for r in entities.mapping(codes).collect()}
    assert rows["[PERSON_A]"] == "John" and rows["[PERSON_A_FORMAL]"] == "Mr Smith" and rows["[PERSON_B_MIDDLE]"] == "Ann" and rows["[PERSON_B_LAST]"] == "Lee"
    assert [r["restored"][:13] for r in entities.restore(out, entities.mapping(codes)).orderBy("doc_id").collect()] == ["Dr John Smith", "Mr John and D"]


def test_the_longest_of_two_namesakes_is_the_parent(spark):
    _, out, _ = people(spark, ["Dr Sean Lintern. Dr Sean Versteegh. Mr Sean."])
    assert out.first()["redacted"] == "Dr [PERSON_A_FIRST_LAST]. Dr [PERSON_B_FIRST_LAST]. Mr [PERSON_B_FIRST]."


def test_null_sessions_and_documents_are_redacted(spark):
    docs = spark.createDataFrame([(None, 1, 1, "mail a@b.nz"), (None, None, 2, "mail a@b.nz or c@d.nz"), ("s", 3, 3, None)], DOCS)
    out, codes = entities.redact_documents(docs, (BY_NAME["email"],))
    assert {(r["doc_id"], r["redacted"]) for r in out.collect()} == {(1, "mail [CONTACT_A]"), (None, "mail [CONTACT_A] or [CONTACT_B]"), (3, None)}
    assert {r["restored"] for r in entities.restore(out, entities.mapping(codes)).collect()} == {"mail a@b.nz", "mail a@b.nz or c@d.nz", None}


def test_control_characters_shift_nothing(spark):
    text = "a\x01b mail x@y.nz \x02\x03 end"
    docs, out, codes = people(spark, [text])
    assert out.first()["redacted"] == "a\x01b mail [CONTACT_A] \x02\x03 end"
    assert entities.restore(out, entities.mapping(codes)).first()["restored"] == text
    found = spark.createDataFrame([("x\x01 yy \x03 y",)], "t string").select(F.explode(scan(F.col("t"), "y+")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in found] == [(3, 5, "yy"), (8, 9, "y")]
    assert [r["text"] for r in on.surname_pairs(docs.withColumn("text", F.lit("\x01 Ann Lee")), spark.createDataFrame([("s", "Lee")], "session_id string, surname string")).collect()] == ["Ann Lee"]
    fixed = entities.fix_partial_leaks(docs.withColumns({"text": F.lit("\x01 Murray"), "leaked": F.lit("\x01 [PERSON_P]ray")}), spark.createDataFrame([("s", "[PERSON_P]", "Mur")], "session_id string, code string, original string"), "leaked")
    assert fixed.first()["fixed"] == "\x01 [PERSON_P]"


def test_overrides_and_dates(spark):
    codes = spark.createDataFrame([("s", "[DATE_A]", "18 May 1978"), ("s", "[PERSON_A]", "Jo"), ("s", "[PERSON_B]", "")], "session_id string, code string, original string")
    own = spark.createDataFrame([("s", "[PERSON_A]", "$1 \\2"), ("s", "[PERSON_Z]", "Zed")], "session_id string, code string, text string")
    docs = spark.createDataFrame([("s", 1, "[PERSON_A] [PERSON_B] [PERSON_Z] [DATE_A] 1978.")], "session_id string, doc_id long, redacted string")
    assert entities.restore(docs, codes, own, normal_dates=True).first()["restored"] == "$1 \\2 [PERSON_B] Zed 18/05/1978."


def by_text(text, rows):
    """Replacement by text in plain Python."""
    codes = {}
    for t, kind, code in rows:
        codes[t.lower()] = max(code, codes.get(t.lower(), ""))
    parts_ = [re.escape(t) + ("(?:'s|s(?![a-zA-Z]))?" if kind.startswith("person") else "") for t, kind, _ in sorted(rows, key=lambda r: (-len(r[0]), r[0]))]

    def shown(m):
        low = m.group().lower()
        if low.endswith("'s"):
            return codes.get(low[:-2], m.group())
        return codes.get(low) or (codes.get(low[:-1]) if low.endswith("s") else None) or m.group()

    return re.sub(r"(?:\b|(?<=\s)|^)(?:" + "|".join(parts_) + r")(?:\b|(?=\s)|$)", shown, text, flags=re.I | re.A)


def test_replacement_by_text(spark):
    rows = [("Jane Smith", "person_client", "[CLIENT_A]"), ("Jane", "person_client", "[CLIENT_B]"), ("a.b+c", "contact", "[CONTACT_A]"), ("Ross", "person_other", "[PERSON_A]"), ("Ros", "person_other", "[PERSON_B]")]
    texts = ["Jane Smith attended. JANE's and Janes, janessa; Jane Smith's.", "mail a.b+c now, axb+c not.", "Ross and Ros and Rosses", "", "nothing here", "Jane\x01 $1 Jane Smiths"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = spark.createDataFrame([(i, *r) for i in range(len(texts)) for r in rows], "doc_id long, text string, type string, code string")
    got = [r["redacted"] for r in parts.redact_by_text(docs, own).orderBy("doc_id").collect()]
    assert got == [by_text(t, rows) for t in texts]
    assert got[0] == "[CLIENT_A] attended. [CLIENT_B] and [CLIENT_B], janessa; [CLIENT_A]."
    lone = spark.createDataFrame([(7, "x"), (8, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["redacted"] for r in parts.redact_by_text(lone, own).collect()} == {7: "x", 8: None}


def test_streams_give_what_the_batch_gives(spark, tmp_path):
    texts = ["Dr John Smith on 1/2/2020. Mr John.", "Mr John, a@b.nz and c@d.nz", None, "", "Dr Ann Lee Park, uncle Ann, Ms Park; a@b.nz \x01 1/3/2021"]
    rows = [(s, 10 * k + i, i, t) for k, s in enumerate(["s", None]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = redact_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), ID_AND_NAME)
    got = {r["doc_id"]: r["redacted"] for r in finished(stream).collect()}
    assert got == {r["doc_id"]: r["redacted"] for r in entities.redact_documents(docs, ID_AND_NAME)[0].collect()}


def test_streams_of_several_batches_and_late_documents(spark, tmp_path):
    """Documents get codes in the order of arrival, as in a batch whose doc_seq is that order; a session's state lasts from one micro-batch to the next."""
    files = [
        [("s", 1, 5, "Dr John Smith met Ann on 1/2/2020, a@b.nz"), ("t", 2, 5, "uncle Jo, a@b.nz"), ("s", 3, 6, "Dr Johnny Marr Smith. x@y.nz")],
        [("s", 4, 1, "Late: Dr Ann Lee, Mr John, c@d.nz"), (None, 5, 1, "Dr Jo Park; Ms Park"), ("s", 6, 2, None)],
        [("t", 7, 9, "Dr Jo Hart, c@d.nz, a@b.nz"), ("s", 8, 9, "Mr Smith and uncle Ann; Dr John Smith; c@d.nz"), (None, 9, 0, "Mr Jo, z@z.nz")],
    ]
    arrived = [(s, i, f * 100 + q, t) for f, rows in enumerate(files) for s, i, q, t in rows]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files come in the order of their times, which are seconds
    source = spark.readStream.schema(spark.createDataFrame([], DOCS).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["doc_id"]: r["redacted"] for r in finished(redact_stream(source, ID_AND_NAME)).collect()}
    want = {r["doc_id"]: r["redacted"] for r in entities.redact_documents(spark.createDataFrame(arrived, DOCS), ID_AND_NAME)[0].collect()}
    assert got == want and got[4].count("CONTACT_C") == 1
    masked = {r["doc_id"]: r["masked"] for r in finished(mask_stream(source, ID_AND_NAME).select("doc_id", "masked")).collect()}
    assert masked[7].endswith("[CONTACT], [CONTACT]") and masked[6] is None and len(masked) == 9


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("o")).repartition(5)
    got = {}
    for r in numbered(df, ("k",), ("o",)).collect():
        got.setdefault(r["k"], []).append((r["o"], r["n"]))
    assert set(got) == {None, 1, 2} and all([n for _, n in sorted(v)] == list(range(len(v))) for v in got.values())
    assert [r["n"] for r in numbered(df, (), ("o",)).orderBy("o").collect()] == list(range(1000))
    assert numbered(df.limit(0), ("k",), ("o",)).count() == 0


def test_an_unknown_type_is_an_error(spark):
    odd = Rule("odd", 0, 0, "x+", "colour", 1.0)
    with pytest.raises(Exception, match="no prefix for type colour"):
        entities.redact_documents(spark.createDataFrame([("s", 1, 1, "a xx")], DOCS), (odd,))[0].collect()


def test_edits_of_nothing(spark):
    codes = people(spark, ["Dr John Smith. Mr John."])[2]
    none = lambda schema: spark.createDataFrame([], schema)
    assert edits.reclassified_keys(codes, none("session_id string, key string, new_type string")).count() == codes.count()
    assert edits.merged_aliases(codes, none("session_id string, alias string, primary string")).count() == codes.count()
    assert edits.without_groups(codes, codes.select("session_id", "key")).count() == 0
    assert review.name_parts(none("session_id string, name string")).count() == 0


def test_mapping_that_is_no_json(spark):
    bad = spark.createDataFrame([("s", "{oops")], "session_id string, json string")
    with pytest.raises(Exception):  # noqa: B017
        parts.mapping_of_json(bad).collect()
    some = spark.createDataFrame([("s", '[{"original": " Jo ", "replacement": "[PERSON_A]"}, {"original": "x"}, {"original": "JO", "replacement": "[PERSON_B]"}]')], "session_id string, json string")
    assert [tuple(r) for r in parts.mapping_of_json(some).collect()] == [("s", "jo", "JO", "[PERSON_B]")]


def test_mentions_of_a_stream_are_places_with_the_same_texts_and_keys(spark):
    from sealgrove.operators.spans import key_of
    from sealgrove.streaming.redaction import TYPES, unpacked

    texts = ["\x1f Ann Cole \x0b", "\t\n\x0c\r X1 \x00", "Éva İx \u3000", "ΟΔΟΣ and Σ", None]
    rows = [(i, t, 0, len(t or "")) for i, t in enumerate(texts)]
    for r in spark.createDataFrame(rows, "i int, text string, s int, e int").select("*", key_of(F.col("text")).alias("key")).collect():
        plain = r["text"] is not None and r["text"].isascii()
        got = unpacked(r["text"], [r["s"], r["e"], 2], None if plain else [r["key"]])
        want = [{"s": 0, "e": r["e"], "text": r["text"], "type": TYPES[1], "key": r["key"]}]
        assert got == ([] if r["text"] is None else want)
