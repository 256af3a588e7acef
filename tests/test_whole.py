"""The whole analysis of texts, sweeps over spans and groups of names, against texts by hand and plain loops."""

import random
import time

from pyspark.sql import functions as F

from sealgrove.functions.names import NAME_TITLES
from sealgrove.operators import duplicates, sweep, whole
from sealgrove.operators import entities as e
from sealgrove.operators.recognizers import BY_NAME, inclusion_rule

RULES = tuple(BY_NAME[n] for n in ("email", "title_name", "relation_name", "known_name", "place_city"))
DOCS = "session_id string, doc_id long, doc_seq int, text string"


def redacted(spark, *texts, rules=RULES, **options):
    docs = spark.createDataFrame([("s", i, i, t) for i, t in enumerate(texts)], DOCS)
    out, codes = e.redact_documents(docs, rules, find=whole.whole_mentions, **options)
    return [r["redacted"] for r in out.orderBy("doc_id").collect()], {r["key"]: r["code"] for r in codes.collect()}


def test_names_are_found_wherever_they_stand(spark):
    """Only "Dr Xavi Quorn" is found by a rule; the other places are found because of it."""
    out, codes = redacted(spark, "Dr Xavi Quorn came. Quorn said XAVI QUORN and xavis dog left. Quornish people stay.")
    assert out == ["Dr [PERSON_A_FIRST_LAST] came. [PERSON_A_LAST] said [PERSON_A_FIRST_LAST] and [PERSON_A_FIRST] dog left. Quornish people stay."]
    assert set(codes) == {"xavi quorn", "quorn", "xavi"}


def test_a_known_surname_extends_a_single_name(spark):
    out, codes = redacted(spark, "Dr Bea Zorn met sister Ylva. Later Ylva Zorn spoke, and Ylva left.", "sister Ylva and Ylva Quist")
    assert "ylva zorn" in codes and "Ylva" not in out[0] and "Zorn" not in out[0]
    assert "ylva quist" not in codes and out[1].endswith(" Quist")  # no known surname


def test_words_models_and_exclusions(spark):
    mention = "array<struct<s:int,e:int,text:string,type:string,confidence:double,rec_ord:int,pat_ord:int>>"
    docs = spark.createDataFrame([("s", 1, 1, "Ward B.C and the Lighthouse: Mr Oddo saw Nils.", [(29, 32, "Mr ", "date", 0.1, 9, 0), (41, 45, "Nils", "person_other", 0.9, 9, 1)]), ("s", 2, 2, None, None), ("s", 3, 3, "", [])], f"{DOCS}, found {mention}")
    rules = (BY_NAME["title_name"], inclusion_rule([("b.c", "organization"), ("light", "location"), ("LIGHTHOUSE", "location")]))
    out, _ = e.redact_documents(docs, rules, find=whole.whole_mentions, model="found", exclude=("oddo",))
    got = {r["doc_id"]: r["redacted"] for r in out.collect()}
    assert got == {1: "Ward [ORG_A] and the [LOCATION_A]: [DATE_A]Oddo saw [PERSON_A].", 2: None, 3: ""}


def test_names_are_taken_literally(spark):
    rules = (inclusion_rule([("a.b(c", "person_other"), ("x\\E|y", "person_other")]),)
    out, _ = redacted(spark, "a.b(c aXb(c A.B(C x\\E|y y", rules=rules)
    assert out == ["[PERSON_A] aXb(c [PERSON_A] [PERSON_B] y"]


def spans_of(rng, docs, n, width):
    return [(d, i, s, s + rng.randint(0, width)) for d in range(docs) for i in range(n) for s in [rng.randint(0, 200)]]


def test_sweeps_against_all_pairs(spark):
    rng = random.Random(7)
    rows = spans_of(rng, 6, 60, 12) + [(None, 1, 0, 5), (None, 2, 3, 9), (None, 3, None, 4)]
    df = spark.createDataFrame(rows, "doc_id int, id long, s int, e int")
    full = [r for r in rows if r[2] is not None]
    pairs = sorted((str(a[0]), a[1], b[1]) for a in full for b in full if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3])
    assert sorted((str(r[0]), r[1], r[2]) for r in sweep.overlapping(df).collect()) == pairs
    inside = lambda a, b: a is not b and a[0] == b[0] and b[2] <= a[2] and a[3] <= b[3] and (b[3] - b[2] > a[3] - a[2] or b[1] < a[1])
    kept = sorted((str(a[0]), a[1]) for a in full if not any(inside(a, b) for b in full))
    assert sorted((str(r["doc_id"]), r["id"]) for r in sweep.outermost(df.filter("s is not null")).collect()) == kept

    found = spark.createDataFrame(spans_of(rng, 6, 40, 12), "doc_id int, n long, s int, e int").filter("e > s")
    over = df.filter("e > s and id % 5 = 0")
    cover = lambda f, x: f["doc_id"] == x["doc_id"] and f["s"] < x["e"] and x["s"] < f["e"] and (min(f["e"], x["e"]) - max(f["s"], x["s"])) / min(f["e"] - f["s"], x["e"] - x["s"]) > 0.5
    xs = over.collect()
    want = sorted((f["doc_id"], f["n"], f["s"], f["e"]) for f in found.collect() if not any(cover(f, x) for x in xs))
    assert sorted(tuple(r) for r in sweep.uncovered(found, over).select("doc_id", "n", "s", "e").collect()) == want
    assert sweep.uncovered(found, over.limit(0)).count() == found.count() and sweep.overlapping(df.limit(0)).count() == 0


def test_a_hundred_thousand_spans_of_a_document(spark):
    df = spark.range(100_000).selectExpr("1 as doc_id", "id", "cast(id * 3 as int) as s", "cast(id * 3 + 4 as int) as e")
    began = time.time()
    assert sweep.overlapping(df).count() == 99_999
    assert sweep.outermost(df).count() == 100_000
    assert time.time() - began < 30


def parts_of(name):
    words = name.lower().split()
    titled = bool(words) and words[0] in NAME_TITLES
    return titled, words[1:] if titled else words


def greedy(names):
    """The rules as loops over one session's names."""
    order = lambda n: (n.lower(), n)
    own = [(n, *parts_of(n)) for n in sorted(names, key=order) if parts_of(n)[1]]
    full = [x for x in own if len(x[2]) > 1]
    firsts, lasts = [x[2][0] for x in full], [x[2][-1] for x in full]
    taken, out, open_ = set(), [], {}
    for f, _, fp in full:
        if f in taken:
            continue
        hits = []
        for o, titled, op in own:
            if o == f or o in taken:
                continue
            if len(op) > 1:
                if (fp[0], fp[-1]) == (op[0], op[-1]) and (titled or len(op) == 2):
                    if titled and lasts.count(op[-1]) > 1:
                        open_.setdefault(o, []).append(f)
                    else:
                        hits.append(o)
            elif op[0] in fp:
                if firsts.count(op[0]) > 1:
                    open_.setdefault(o, []).append(f)
                else:
                    hits.append(o)
            taken |= set(hits)
        if hits:
            taken.add(f)
            out += [(f, o, "high") for o in hits]
    for o in sorted(open_, key=order):
        if o not in taken:
            out += [(f, o, "low") for f in sorted(open_[o], key=order) if f not in taken]
            taken.add(o)
    single = [x for x in own if len(x[2]) == 1]
    groups = {}
    for p, _, pp in single:
        for o, _, op in single:
            if o != p and (pp[0].startswith(op[0])):
                groups.setdefault(p, []).append(o)
    for p in sorted(groups, key=order):
        free = [o for o in sorted(groups[p], key=order) if o not in taken]
        if p not in taken and free:
            for o in free:
                if o not in taken:
                    taken |= {o, p}
                    out.append((p, o, "low"))
    return out


def test_groups_of_names(spark):
    rng = random.Random(11)
    first, last, titles = ["Sean", "Jo", "Joanna", "Ann", "Smith"], ["Lintern", "Versteegh", "Smith", "Jo"], ["", "", "Mr ", "Dr. "]
    sessions = {"two": ["Sean", "Sean Lintern", "Sean Versteegh"], "ext": ["Sean Versteegh", "Sean Michael Versteegh", "sean", "Mr"], None: ["Jo", "Joanna", "jo"], "one": ["Ann"], "same": ["Ann Smith", "ann smith", ""]}
    for k in range(40):
        sessions[f"r{k}"] = sorted({rng.choice(titles) + " ".join([rng.choice(first)] + [rng.choice(first + last) for _ in range(rng.choice([0, 0, 1, 1, 2]))]) for _ in range(8)})
    df = spark.createDataFrame([(s, n) for s, ns in sessions.items() for n in ns], "session_id string, name string")
    out = duplicates.duplicate_persons(df).collect()
    for s, ns in sessions.items():
        assert [(r[1], r[2], r[3]) for r in out if r[0] == s] == greedy(ns), s
    assert greedy(sessions["two"]) == [("Sean Lintern", "Sean", "low"), ("Sean Versteegh", "Sean", "low")]
    assert ("Sean Michael Versteegh", "Sean Versteegh", "high") in greedy(sessions["ext"])
    ranked = duplicates.in_order(duplicates.duplicate_persons(df)).filter("session_id = 'ext'").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and ranked[0]["confidence"] == "high"


def test_names_of_one_code_are_merged_already(spark):
    df = spark.createDataFrame([("s", "Ann Smith", "[PERSON_A]"), ("s", "Ann", "[PERSON_A]"), ("s", "Bo Reed", "[PERSON_B]"), ("s", "Bo", "[PERSON_C]")], "session_id string, name string, code string")
    assert [tuple(r) for r in duplicates.duplicate_persons(df).collect()] == [("s", "Bo Reed", "Bo", "high")]
    assert duplicates.duplicate_persons(df.limit(0)).count() == 0


def test_no_text_is_lost_with_repeated_rows(spark):
    docs = spark.createDataFrame([("s", 1, 1, "Dr Ann Zorn, Zorn"), ("s", 1, 1, "Dr Ann Zorn, Zorn"), (None, None, 1, "Zorn")], DOCS)
    out, codes = e.redact_documents(docs, RULES, find=whole.whole_mentions)
    got = sorted((str(r["session_id"]), r["redacted"]) for r in out.collect())
    assert got[0] == ("None", "Zorn") and got[1] == got[2] and "Zorn" not in got[1][1]
    assert e.restore(out, e.mapping(codes)).filter(F.col("session_id").isNull()).first()["restored"] == "Zorn"
