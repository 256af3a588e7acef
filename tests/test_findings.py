"""Findings that become entities, and what is shown of an analysis: rules by hand, odd input."""

import pytest
from pyspark.sql import functions as F

from sealgrove.operators import entities, findings, results
from sealgrove.operators.joins import identified
from sealgrove.operators.recognizers import BY_NAME, Rule

MENTION = "array<struct<s:int,e:int,text:string,type:string,confidence:double,rec_ord:int,pat_ord:int>>"
DOCS = "session_id string, doc_id long, doc_seq long, text string"


def people(text, *names):
    return [(text.index(x), text.index(x) + len(x), x, "person_other", 0.8, 0, 0) for x in names]


def test_tags_become_types(spark):
    tags = [(0, 2, "Jo", "personalName", None), (5, 9, "Hutt", "placeName", 0.5), (5, 9, "Hutt", "verb", 0.9), (4, 4, "", "placeName", 0.9)]
    df = spark.createDataFrame([(tags,), (None,), ([],)], "t array<struct<s:int,e:int,text:string,tag:string,confidence:double>>")
    got = [[(m["text"], m["type"], m["confidence"]) for m in r["m"]] for r in df.select(findings.tagged_mentions(F.col("t")).alias("m")).collect()]
    assert got == [[("Jo", "person_other", 0.0), ("Hutt", "location", 0.5)], [], []]


def test_surnames_are_looked_for_in_the_whole_text(spark):
    rows = [
        ("Ann said. Then Ann  Lee came, Ann Park not.", ["Ann"], {"Ann": "Lee"}), ("Ann The patient, Ann Lee", ["Ann"], {"Ann": "Lee"}), ("Ann\nLee, Ann lee, annA Lee", ["Ann"], {}),
        ("J.x Smith and JAx Smith", ["J.x"], {"J.x": "Smith"}), ("Ann Lee Park", ["Ann", "Lee", "Ann Lee"], {"Ann": "Lee", "Lee": "Park"}), ("", ["Ann"], {}), (None, ["Ann"], {}), ("Ann Lee", [], {}), ("Ann Lee", None, {}),
    ]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(rows)], "i int, t string, n array<string>")
    got = {r["i"]: r["m"] for r in df.select("i", findings.surnames(F.col("t"), F.col("n")).alias("m")).collect()}
    assert got == {i: m for i, (_, _, m) in enumerate(rows)}


def test_first_names_where_they_stand_alone(spark):
    a = "Sean Park and SEAN, Seans; Seaner. Jo Park, Jo."
    b = "Ann Lee met Ann Park. Ann"
    c = "Ann Lee, Ann; Anns"
    rows = [(0, a, people(a, "Sean Park", "Jo Park")), (1, b, people(b, "Ann Lee", "Ann Park")), (2, c, people(c, "Ann Lee") + [(9, 12, "ann", "person_other", 0.8, 0, 0)]), (3, None, None), (4, "", [])]
    df = spark.createDataFrame(rows, f"i int, t string, m {MENTION}")
    got = {r["i"]: [(x["s"], x["e"], x["text"]) for x in r["x"]] for r in df.select("i", findings.first_names(F.col("t"), F.col("m")).alias("x")).collect()}
    assert got == {0: [(14, 18, "Sean"), (20, 25, "Sean")], 1: [(12, 15, "Ann"), (22, 25, "Ann")], 2: [], 3: [], 4: []}


def test_findings_get_codes_behind_their_sessions(spark):
    """Ids repeat and are missing; what is known stays as it is; parts of a person share the person's code; what stands nowhere isn't dealt one."""
    rows = [("s", 1, 0, "Dr Ann Lee came. a@b.nz"), ("s", None, 1, "Mr Bo Jay Ray saw Bo, Ray and Jay; Mr Ray. High Street"), ("t", 1, 0, "High Street, high street. Tom Tom"), (None, 1, 0, "Eva Poe. Evas")]
    docs = identified(spark.createDataFrame(rows, DOCS), "text")
    docs = docs.unionByName(docs.filter("session_id = 't'"))
    known = entities.kept_mentions(docs.drop("row"), (Rule("title", 0, 0, r"\bAnn Lee\b", "person_other", 0.9), BY_NAME["email"])).distinct()
    wanted = [("Ann Lee", "person_client"), ("a@B.nz", "contact"), ("Mr Bo Jay Ray", "person_client"), ("High Street", "location"), ("high street", "location"), ("Nowhere", "location"), ("Tom Tom", "person_other"), ("Eva Poe", "person_other")]
    found = docs.crossJoin(spark.createDataFrame(wanted, "text2 string, type string")).select("row", F.col("text2").alias("text"), "type", F.lit(0.8).alias("confidence"))
    new = findings.found_mentions(docs, known, found)
    before = {(r["session_id"], r["key"]): r["code"] for r in entities.assign_codes(known).collect()}
    after = {(r["session_id"], r["key"]): r["code"] for r in entities.assign_codes(known.unionByName(new)).collect()}
    assert before == {("s", "ann lee"): "[PERSON_A_FIRST_LAST]", ("s", "a@b.nz"): "[CONTACT_A]"} and before.items() <= after.items()
    assert {k: v for k, v in after.items() if k not in before} == {
        ("s", "mr bo jay ray"): "[CLIENT_A_FULL]", ("s", "ray"): "[CLIENT_A_LAST]", ("s", "jay"): "[CLIENT_A_MIDDLE]", ("s", "mr ray"): "[CLIENT_A_FORMAL]", ("s", "high street"): "[LOCATION_A]",
        ("t", "high street"): "[LOCATION_A]", ("t", "tom tom"): "[PERSON_A_FIRST_LAST]", ("t", "tom"): "[PERSON_A_FIRST_LAST]", (None, "eva poe"): "[PERSON_A_FIRST_LAST]", (None, "eva"): "[PERSON_A_FIRST]", (None, "poe"): "[PERSON_A_LAST]",
    }
    at = sorted((r["s"], r["e"]) for r in new.filter("session_id = 't' and key = 'high street'").collect())
    assert at == [(0, 11), (13, 24)]
    assert findings.found_mentions(docs.limit(0), known.limit(0), found.limit(0)).count() == 0


def test_positions_have_all_their_issues(spark):
    entity = [("bc", [[1, 3], [1], None, [-1, 2], [2, 9], [3, 1], [0, 2], [7, 9], [None, 2], [2, 2]])]
    rows = [(0, "abcd", entity), (1, None, entity), (2, "abcd", None), (3, "", [("x", [[0, 1]])]), (4, "abcd", [("a", None)])]
    df = spark.createDataFrame(rows, "i int, t string, x array<struct<text:string,positions:array<array<int>>>>")
    got = {r["i"]: [(x["nth"], x["issue"]) for x in r["y"]] for r in df.select("i", results.position_issues(F.col("t"), F.col("x")).alias("y")).collect()}
    assert got == {
        0: [(1, "invalid_format"), (2, "invalid_format"), (3, "start_out_of_bounds"), (4, "end_out_of_bounds"), (5, "invalid_range"), (6, "text_mismatch"),
            (7, "start_out_of_bounds"), (7, "end_out_of_bounds"), (8, "invalid_format"), (9, "invalid_range")],
        1: [], 2: [], 3: [(0, "start_out_of_bounds"), (0, "end_out_of_bounds")], 4: [],
    }


def test_originals_are_marked_in_restored_texts(spark):
    rows = [(0, "Ann, ann and Joanne (a.b) axb aaa", ["Ann", "a.b", "", "aa", "Ann"]), (1, None, ["x"]), (2, "x", None), (3, "", ["x"])]
    df = spark.createDataFrame(rows, "i int, t string, o array<string>")
    got = {r["i"]: sorted((x["original"], x["s"], x["e"]) for x in r["m"]) for r in df.select("i", results.restored_marks(F.col("t"), F.col("o")).alias("m")).collect()}
    assert got == {0: [("Ann", 0, 3), ("Ann", 5, 8), ("Ann", 15, 18), ("a.b", 21, 24), ("aa", 30, 32)], 1: [], 2: [], 3: []}


def test_counts_and_lists(spark):
    schema = "row int, doc_id long, key string, original string, type string, first_start int, n_positions long"
    df = spark.createDataFrame([(1, None, "a", "A", "date", 5, 2), (1, None, "b", "B", "date", 1, 1), (1, None, "c", "C", "contact", 0, 1), (2, None, "d", "D", "colour", 0, 1)], schema)
    counts = {r["row"]: r for r in results.result_counts(df).collect()}
    assert (counts[1]["entity_count"], counts[1]["replacement_count"], counts[1]["n_date"], counts[2]["n_date"]) == (3, 4, 2, 0)
    lists = sorted((r["row"], r["nth"], r["display_name"], r["originals"]) for r in results.entity_lists(df).collect())
    assert lists == [(1, 1, "Contact Info", ["C"]), (1, 2, "Date", ["B", "A"]), (2, 1, "colour", ["D"])]
    codes = spark.createDataFrame([("s", "date"), ("s", None), (None, "identifier"), (None, "person_provider")], "session_id string, type string")
    got = {r["session_id"]: (r["total"], r["date"], r["identifier"], r["person_provider"], r["other"]) for r in results.session_summary(codes).collect()}
    assert got == {"s": (2, 1, 0, 0, 1), None: (2, 0, 1, 1, 0)}


@pytest.mark.parametrize("rows", [[], [("s", "A"), ("s", "A")]])
def test_second_pass_names_who_found_what(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, text string")
    assert sorted(tuple(r) for r in findings.second_pass(a=df, b=df).collect()) == [("s", "A", "a"), ("s", "A", "b")][: 2 * len(rows)]
