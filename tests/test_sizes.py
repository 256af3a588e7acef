"""What only larger or odd tables show: notes that several orders share, codes that a remark's placeholders happen to be, plans that neither repeat a scan nor broadcast texts."""

import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sealgrove.operators.dictionary import Words, with_hits
from sealgrove.operators.recognizers import mentions
from sealgrove.operators.subwords import Vocabulary, with_units
from sealgrove.plans import entities, findings, registry
from sealgrove.plans.detection import SQL_RULES
from sealgrove.plans.notes import notes

QUERIES = {k: v for m in registry.MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in registry.MODULES for k, v in m.ORACLES.items()}


def against_sql(spark, folder, name, table="orders"):
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cursor = c.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(map(repr, cursor.fetchall()))
    return got


def orders(spark, folder, keys):
    rows = [(k, c, "O", 1.0, datetime.datetime(1998, 2, 6), "5-LOW") for k, c in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")


def test_orders_of_one_note_are_swept_each(spark, tmp_path):
    orders(spark, tmp_path, [(8, 5), (8 + 1_531_530_000, 5), (9, 5)])  # the first two agree in text, session and doc_id
    assert len(against_sql(spark, tmp_path, "sweep_pairs")) == 3


def test_a_remark_is_restored_by_the_users_texts_alone(spark, tmp_path):
    orders(spark, tmp_path, [(k, 50 * k) for k in range(500)])  # one session, whose 459th identifier is [ID_QQ]
    assert all(" nobody [ID_QQ]" in x for x in against_sql(spark, tmp_path, "restore_with_overrides"))


def test_a_scan_is_in_the_plan_once(spark, sf):
    plan = mentions(notes(spark, sf), SQL_RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and "size(" not in plan.split("Filter", 1)[1].split("\n", 1)[0]


@pytest.mark.parametrize("query", [findings.position_checks, entities.position_filter])
def test_texts_are_not_broadcast(spark, sf, query):
    assert "Broadcast" not in query(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_terms_of_documents_are_not_broadcast(spark, sf):
    from sealgrove.operators import findings as fi
    from sealgrove.operators.joins import identified

    docs, known = identified(notes(spark, sf), "text"), entities._found(spark, sf)
    plan = fi.found_mentions(docs, known, findings._finds(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1  # the last number of each session


def test_words_of_documents_make_no_rows_to_find_terms(spark, sf):
    from sealgrove.operators import findings as fi
    from sealgrove.operators.joins import identified

    docs, known = identified(notes(spark, sf), "text"), entities._found(spark, sf)
    plan = fi.found_mentions(docs, known, findings._finds(docs))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([x for x in plan if "Generate explode" in x and "_terms" not in x and "mentions" not in x]) == 0


def test_terms_are_found_in_their_texts_as_by_rows(spark):
    from sealgrove.operators import findings as fi
    from sealgrove.operators.review import occurrences_of_terms

    texts = ["Ann saw ann's Anns, anns and Anne; ANN Cole's", "Cole-Smith and cole smith, Coles Smith", "mass Mass masss", None, "", "Éva's éva İstanbul ann"]
    terms = ["Ann", "Ann Cole", "cole-smith", "Cole Smith", "Coles", "mass", "Mas", "éva", "ann", "!x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("session_id", F.col("doc_id").cast("string"))
    rows = docs.select("session_id", F.explode(F.array(*map(F.lit, terms))).alias("term"))
    want = sorted((r["doc_id"], r["term"], r["s"], r["e"]) for r in occurrences_of_terms(docs, rows).collect())
    first = F.lower(F.regexp_extract("term", rf"^{fi.WORD}+", 0))
    listed = rows.select("session_id", F.col("term").alias("key"), F.col("term").alias("text"), F.lit("date").alias("type"), F.lit(1.0).alias("confidence"), F.lit(0).alias("pat_ord"), first.alias("first")).filter("first <> ''")
    listed = listed.groupBy("session_id").agg(F.collect_list(F.struct("key", "text", "type", "confidence", "pat_ord", "first")).alias("t"))
    got = docs.join(listed, "session_id").select("doc_id", F.explode(fi.terms_in(F.col("text"), F.col("t"))).alias("x")).collect()
    assert want and sorted((r["doc_id"], r["x"]["key"], r["x"]["s"], r["x"]["e"]) for r in got) == want


def test_marks_move_no_text_but_the_restored_one(spark, sf):
    plan = findings.restored_marks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "_right_row" not in plan and "AS c3#" in plan and not [x for x in plan.splitlines() if " text#" in x and " AS c2#" in x]


def test_documents_are_spliced_alike_with_and_without_counts(spark):
    from sealgrove.operators import entities as e

    rows = [("s", 1, 1, "NHI ABC1234 and ABC1234, é ZZZ0016"), ("s", 1, 1, "NHI ABC1234 and ABC1234, é ZZZ0016"), (None, 2, 2, None), (None, None, 3, ""), ("s", None, 4, "none")]
    docs = spark.createDataFrame(rows, "session_id string, doc_id long, doc_seq long, text string")
    (a, _), (b, _) = (e.redact_documents(docs, entities.RULES, counted=x) for x in (True, False))
    assert a.drop("n_entities").columns == b.columns and "collect_set" not in b._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, a.drop("n_entities").collect())) == sorted(map(repr, b.collect()))


def test_versions_are_counted_along_and_not_paired_with_all_steps(spark):
    from sealgrove.operators import versions as ve

    rows = [("s", i, "draft" if i % 2 else "save", 1, f"v{i}") for i in range(1, 5)] + [(None, 1, "draft", None, "x"), (None, 2, "clear", None, None)]
    changes = spark.createDataFrame(rows, ve.CHANGES)
    out = ve.state_at(ve.versions(changes), changes.select("session_id", "at"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and "valid_from" not in "".join(x for x in plan.splitlines() if "Join" in x)
    got = sorted((str(r["session_id"]), r["at"], r["item"], r["doc_id"], r["text"]) for r in out.collect())
    assert got == [("None", 1, "draft", None, "x"), ("s", 1, "draft", 1, "v1"), ("s", 2, "draft", 1, "v1"), ("s", 2, "saved", 1, "v1"), ("s", 3, "draft", 1, "v3"), ("s", 3, "saved", 1, "v1"), ("s", 4, "draft", 1, "v3"), ("s", 4, "saved", 1, "v3")]


def handed(monkeypatch, docs, operator, texts):
    """The batches that an Arrow pass hands over for one batch of texts."""
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    operator(docs)
    return list(runs[0](iter([pa.RecordBatch.from_pydict({"text": texts})])))


def test_hits_of_many_texts_are_not_held_at_once(spark, monkeypatch):
    texts = ["ab " * 40_000, None, "ab", "ab " * 40_000, ""]
    out = handed(monkeypatch, spark.createDataFrame([("",)], "text string"), lambda d: with_hits(d, Words([("ab", "x")])), texts)
    assert [b.num_rows for b in out] == [1, 3, 1]
    assert [x for b in out for x in b.column(0).to_pylist()] == texts and [len(x) for b in out for x in b.column(1).to_pylist()] == [40_000, 0, 1, 40_000, 0]


def test_units_of_many_texts_are_not_held_at_once(spark, monkeypatch):
    texts = ["ab " * 70_000, None, "ab", "ab " * 70_000, ""]
    out = handed(monkeypatch, spark.createDataFrame([("",)], "text string"), lambda d: with_units(d, Vocabulary([("▁ab", 7)])), texts)
    assert [b.num_rows for b in out] == [1, 3, 1]
    assert [x for b in out for x in b.column(0).to_pylist()] == texts and [len(x) for b in out for x in b.column(1).to_pylist()] == [70_000, 0, 1, 70_000, 0]
    assert out[1].column(1).to_pylist()[1] == [{"id": 7, "s": 0, "e": 2}]


def test_goals_of_renames_are_looked_at_without_texts(spark):
    from sealgrove.operators import files as fl

    files = spark.createDataFrame([(f"f{k}", f"t{k}") for k in range(6)], "path string, text string")
    rows = [("delete", "f0", None), ("rename", "f1", "new"), ("rename", "f2", "new"), ("rename", "f3", "f4"), ("rename", "f9", "other"), ("rename", None, "x"), ("rename", "f5", None), ("create", "g", "text")]
    commands = spark.createDataFrame([(*r, "", 1) for r in rows], "command string, path string, a string, b string, line int")
    out, answers = fl.commanded(files, commands)
    plan = answers._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("_text" in x for x in plan if "Window" in x)
    got = {(r["command"], r["path"]): r["answer"] for r in answers.collect()}
    assert len(got) == 8 and got["rename", "f1"] == "Successfully renamed f1 to new" and got["rename", "f2"] == "Error: The destination new already exists"
    assert got["rename", "f3"] == "Error: The destination f4 already exists" and got["rename", None] == "Error: Missing path"
    assert sorted((r["path"], r["text"]) for r in out.filter("path <> 'f5' and path is not null").collect()) == [("f2", "t2"), ("f3", "t3"), ("f4", "t4"), ("g", "text"), ("new", "t1")]


def test_lists_of_words_are_tries_that_match_the_same():
    import re

    from sealgrove.operators.recognizers import BY_NAME, factored

    text = "Sean te ao EX-WIFE Ngata; her sister Ann Lee, ex-husband Bo. Dr. Jo Smith; Dr Fr Mrs Rev Reverend Sister Mary, 3 July 2001, June 4, 2002, Marchy 1 2000, seant in Ponsonby, Mt Eden, 4 May 1999"
    for name in ("known_name", "relation_name", "title_name", "date_month_day", "date_day_month", "place_suburb"):
        pattern = BY_NAME[name].pattern
        assert factored(pattern) != pattern and not re.search(r"\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}\|\w{4,}", factored(pattern))
        scoped = lambda p: re.sub(r"^\(\?i\)(.*?)\(\?-i\)", r"(?i:\1)", p) if "(?-i)" in p else p
        found = [m.span() for m in re.finditer(scoped(pattern), text, re.ASCII)]
        assert found and found == [m.span() for m in re.finditer(scoped(factored(pattern)), text, re.ASCII)]
    kept = r"\b(?:ab|ab-c|d|e|f|g|h|i|j)\b"
    assert factored(kept) == kept  # the first of two words that begin at a place counts


def test_few_and_many_spans_lose_their_overlaps_alike(spark):
    import random

    from pyspark.sql import functions as F

    from sealgrove.functions.scan import MENTIONS
    from sealgrove.operators import spans as sp

    r = random.Random(3)
    rows = []
    for n in (0, 1, 2, 5, 61, 62, 63, 200):
        rows += [(n, [(s := r.randrange(3 * n), s + r.randrange(1, 6), "x" * r.randrange(1, 4), "t", r.choice((0.5, 0.9)), r.randrange(3), k) for k in range(n)]) for _ in range(5)]

    def plain(spans):
        out = []
        for x in sorted(spans, key=lambda x: (x[0], x[5], x[6], x[1])):
            if not out or x[0] >= out[-1][1]:
                out.append(x)
            elif (x[4], len(x[2])) > (out[-1][4], len(out[-1][2])):
                out[-1] = x
        return out

    df = spark.createDataFrame(rows, f"n int, spans {MENTIONS}").select("spans", sp.without_overlaps(F.col("spans")).alias("kept"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftleft" in plan
    for x in df.collect():
        assert [tuple(m) for m in x["kept"]] == plain([tuple(m) for m in x["spans"]])


def test_notes_are_dealt_to_more_tasks_than_there_are_cores(spark, sf):
    parts = notes(spark, sf).rdd.getNumPartitions()
    assert parts >= 8 and parts >= 2 * spark.sparkContext.defaultParallelism


def test_plain_texts_are_searched_by_batches_and_others_natively_alike(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from sealgrove.operators import recognizers as rc

    r = random.Random(5)
    words = "Sean dr Dr. Mrs ABC1234 021-555-1234 09 5551234 +64 0800 555 123 a.b@x.nz 3/4/2001 2001-03-04 March 3, 4 2001 May Ponsonby Mt Eden sister Partner Ann Lee Middlemore Hospital 12-34 1,250.5 MRN: X123 CR-12345 High Street".split(" ")
    odd = ["\x01", "\x03", "é", "K", " "]
    rows = [(i, "".join(r.choice(words) + r.choice((" ", "", "\x0b", "-", "\n", "\x00")) + (r.choice(odd) if i % 3 == 0 and r.random() < 0.2 else "") for _ in range(i % 40))) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, None)], "doc_id long, text string")
    found = lambda: {x["doc_id"]: x["mentions"] for x in rc.detect(df, (*rc.RULES, *rc.MODEL_RULES), exclude=("SEAN", " ann lee ")).select("doc_id", F.array_sort("mentions").alias("mentions")).collect()}
    assert [x.name for x in rc.RULES if not rc._searched_whole(x)] == ["id_alnum"]
    by_batches = found()
    monkeypatch.setattr(rc, "common", lambda pattern: False)
    assert by_batches == found() and sum(map(len, by_batches.values())) > 5000


@pytest.mark.parametrize("pattern", [r"(?=a)b", r"a*", r"\ba?", r"a++", r"a+?", r"[a-z&&[b]]", r"a.b", r"^a", r"a$", r"\va", r"\1", "é", r"[^\W]", r"a{2}+"])
def test_patterns_that_engines_read_differently_stay_native(pattern):
    from sealgrove.operators.plain import common

    assert not common(pattern)


def test_a_batch_is_searched_in_parts(monkeypatch):
    from sealgrove.operators import plain

    monkeypatch.setattr(plain, "LONGEST", 6)
    fields = [pa.field(n, t) for n, t in zip("s e text type confidence rec_ord pat_ord".split(), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()), strict=True)]
    rules = [(r"\bto ([a-z])", 1, ("x",), "t", 0.5, 1, 2), (r"\d", 0, (), "n", 0.9, 3, 4)]
    got = plain._found(pa.array(["", "to a1", None, "to x", "é1", "1234567", "22"]).slice(1), rules, fields).to_pylist()
    short = [x and [(m["s"], m["e"], m["text"], m["type"], m["confidence"], m["rec_ord"], m["pat_ord"]) for m in x] for x in got]
    assert short == [[(3, 4, "a", "t", 0.5, 1, 2), (4, 5, "1", "n", 0.9, 3, 4)], None, [], None, None, [(0, 1, "2", "n", 0.9, 3, 4), (1, 2, "2", "n", 0.9, 3, 4)]]


def test_unknown_placeholders_are_made_distinct_behind_the_join(spark):
    from sealgrove.operators import entities as e

    docs = spark.createDataFrame([("s", 1, "[DATE_A] 1999 [PERSON_B] [PERSON_B] [ID_C_FIRST]"), ("s", 1, "[PERSON_B][DATE_Q] 2001"), (None, 2, "[ID_A]"), ("t", 3, None)], "session_id string, doc_id long, text string")
    codes = spark.createDataFrame([("s", "[DATE_A]"), (None, "[ID_A]"), ("t", "[PERSON_B]")], "session_id string, code string")
    out = e.unknown_placeholders(docs, codes, "text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate") and plan.count("Aggregate") == 1
    assert sorted(map(tuple, out.collect())) == [("s", 1, "[DATE_Q]"), ("s", 1, "[ID_C_FIRST]"), ("s", 1, "[PERSON_B]")]


def test_overlaps_are_settled_by_batches_as_natively(spark):
    import random

    from pyspark.sql import functions as F

    from sealgrove.operators import recognizers as rc
    from sealgrove.operators import spans as sp

    r = random.Random(11)
    words = "Sean dr Mrs ABC1234 021-555-1234 09 5551234 0800 555 123 a.b@x.nz 3/4/2001 2001-03-04 March 3, 4 May 2001 sister Partner Ann Lee 12-34 1,250.5 é \x02".split(" ")
    rows = [(i, "".join(r.choice(words[: -2 if i % 3 else None]) + r.choice((" ", "", "-")) for _ in range(i % 50))) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, None)], "doc_id long, text string")
    settled = rc.settled(df, entities.RULES)
    assert "_apart" not in settled.columns and "shiftleft" in settled._jdf.queryExecution().optimizedPlan().toString() and settled.columns == ["doc_id", "mentions"]
    kept = {x["doc_id"]: x["mentions"] for x in settled.collect()}
    want = {x["doc_id"]: x["m"] for x in rc.detect(df, entities.RULES).select("doc_id", sp.without_overlaps(F.col("mentions")).alias("m")).collect()}
    assert kept == want and sum(len(x or ()) for x in kept.values()) > 2000
    lists = (*entities.RULES, Words([("lee", "x")]))
    assert {x["doc_id"]: x["mentions"] for x in rc.settled(df, lists).collect()} == {x["doc_id"]: x["m"] for x in rc.detect(df, lists).select("doc_id", sp.without_overlaps(F.col("mentions")).alias("m")).collect()}


def test_runs_of_overlaps_are_settled_as_one_by_one():
    import random

    import numpy as np

    from sealgrove.operators.plain import _apart

    r = random.Random(4)
    for n in [*range(1, 12), 300]:
        spans = sorted((s := r.randrange(3 * n), s + r.randrange(1, 9), r.choice((0.5, 0.9))) for _ in range(n))
        kept = []
        for k, x in enumerate(spans):
            if not kept or x[0] >= spans[kept[-1]][1]:
                kept.append(k)
            elif (x[2], x[1] - x[0]) > (spans[kept[-1]][2], spans[kept[-1]][1] - spans[kept[-1]][0]):
                kept[-1] = k
        assert np.flatnonzero(_apart(*(np.array(x) for x in zip(*spans, strict=True)))).tolist() == kept


def test_texts_and_spans_are_spliced_in_sorted_order(spark):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    from sealgrove.operators.joins import identified
    from sealgrove.operators.splicing import spliced

    texts = ["", None, "abc", "é😀x😀", "no spans", *(f"{i} äb 😀 c {'x' * (i % 7)}" for i in range(300))]
    docs = spark.createDataFrame([("s" if i % 2 else None, i, t, {"k": i}) for i, t in enumerate(texts)], "session_id string, doc_id long, text string, more map<string,int>")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0"))  # copies
    rows = identified(docs, "text")
    cut = {i: [] if t is None or t == "no spans" else [(k, k + 1 + (i + k) % 2, f"[Ü{k}]") for k in range(0, max(len(t) - 1, 0), 2)] for i, t in enumerate(texts)}
    cut[0] = [(0, 0, "[all]")]
    spans = spark.createDataFrame([(i, *x) for i, xs in cut.items() for x in xs], "doc_id long, s int, e int, code string").join(rows.select("doc_id", "row"), "doc_id").drop("doc_id")  # the one join of the plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # spans and copies of a document come in several batches
    try:
        out = spliced(rows, spans, "text", "new", "code")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 1 and "collect_" not in plan and out.columns == ["session_id", "doc_id", "text", "more", "new"]
        got = [(x["doc_id"], x["session_id"], x["text"], x["more"]["k"], x["new"]) for x in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def plain(i, t):
        for s, e, code in reversed(cut[i]):
            t = t[:s] + code + t[e:]
        return t

    key = lambda x: (x[0],)
    want = [(i, "s" if i % 2 else None, t, i, plain(i, t)) for i, t in enumerate(texts) for _ in range(2 if i % 3 == 0 else 1)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert spliced(rows, spans, "text", "text", "code").columns == ["session_id", "doc_id", "text", "more"]
    with pytest.raises(PythonException, match="spans overlap"):
        spliced(rows, spans.withColumn("e", F.col("e") + 3), "text", "new", "code").collect()


def test_keys_of_several_columns_meet_by_their_hash(spark):
    from pyspark.sql import functions as F

    from sealgrove.operators.joins import joined

    a = spark.createDataFrame([("s", "k", 1), (None, "k", 2), ("s", None, 3), ("k", None, 4)], "session_id string, key string, n int")
    b = spark.createDataFrame([("s", "k", "x"), (None, "k", "y"), ("s", None, "z")], "session_id string, key string, v string")
    out = joined(a, b, ("session_id", "key"), large=True)
    keys = out._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin [", 1)[1]
    assert keys.startswith("xxhash64(session_id")
    assert sorted((x["n"], x["v"]) for x in out.collect()) == [(1, "x"), (2, "y"), (3, "z")]
    other = b.withColumn("key", F.lit(1).cast("int"))
    assert joined(a.withColumn("key", F.lit(1).cast("long")), other, ("session_id", "key")).count() == 5  # hashes of integers of two sizes differ


def test_mentions_are_dealt_by_document_once(spark, sf):
    plan = findings.result_counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
