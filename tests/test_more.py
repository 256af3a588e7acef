"""Sub-word units, tool calls, layered settings, versions of documents and Markdown, against plain loops and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from sealgrove.operators import markdown as md
from sealgrove.operators import settings as st
from sealgrove.operators import subwords as sw
from sealgrove.operators import versions as ve
from sealgrove.operators.conversations import pruned


def units_of(vocabulary, text):
    """Longest match by trying all lengths."""
    out, i = [], 0
    while i < len(text or ""):
        if text[i].isspace():
            i += 1
            continue
        first = i == 0 or text[i - 1].isspace()
        end = i
        while end < len(text) and not text[end].isspace():
            end += 1
        for k in range(end, i, -1):
            piece = (sw.WORD if first else "") + text[i:k]
            if piece in vocabulary:
                out.append((vocabulary[piece], i, k))
                break
        else:
            k = i + 1
            out.append((vocabulary.get(text[i], sw.UNKNOWN), i, k))
        i = k
    return out


def test_units_against_all_lengths(spark):
    rng = random.Random(8)
    pieces = {("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 4))): i for i in range(60)}
    texts = ["".join(rng.choice("abcdé😀  \n") for _ in range(rng.randint(0, 50))) for _ in range(200)] + [None, "", " \t\n ", "a" * 5000, "▁ab"]
    pieces["▁"] = 900  # the word mark alone is a unit only where it stands in the text
    table = spark.createDataFrame([*pieces.items(), (None, 7), ("", 8)], "piece string, id int")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("UNITS", F.lit("own"))
    out = sw.with_units(df, sw.vocabulary(table))
    assert out.columns == ["id", "text", "units"]
    for r in out.collect():
        assert [tuple(u) for u in r["units"]] == units_of(pieces, r["text"])


def test_words_are_forgotten_and_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(sw, "CACHE", 3)
    monkeypatch.setattr(sw, "AT_ONCE", 7)
    pieces = {"▁ab": 1, "c": 2, "▁": 3}
    words = sw.Vocabulary(pieces.items())
    for text in ("ab abc\u3000\x1fab " * 9, "c" * 50 + " ab", "\u2028" * 20, "d😀 ab\x85ab" * 5):
        assert [tuple(u) for u in words.of_text(text).T.tolist()] == units_of(pieces, text)
        assert len(words.begin) < 12


def test_empty_texts_have_one_empty_window(spark, tmp_path):
    from sealgrove.plans.more import subword_units

    spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "Ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ab")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = subword_units(spark, str(tmp_path))
    assert sorted(tuple(r)[:6] for r in out.collect()) == [(1, 0, 0, None, None, 2), (2, 0, 0, None, None, 2), (3, 0, 0, None, None, 2), (4, 2, 0, 0, 2, 4)]
    top = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert " units#" not in top and "(units#" not in top  # windows don't each carry all units of their text


@pytest.mark.parametrize("n", [0, 1, 509, 510, 511, 1004, 1005, 2000])
def test_windows_lose_nothing(spark, n):
    df = spark.range(1).select(F.expr(f"transform(sequence(0, {n}), i -> named_struct('id', cast(i as int), 's', cast(i as int), 'e', cast(i + 1 as int)))").alias("units")).withColumn("units", F.slice("units", 1, n) if n else F.slice("units", 1, 0))
    found = df.select(F.explode(sw.windows(F.col("units"), shared=16)).alias("w")).select("w.*").orderBy("window").collect()
    seen = [u["id"] for w in found for u in w["units"]]
    assert sorted(set(seen)) == list(range(n)) and all(len(w["units"]) <= 510 for w in found)
    assert all([u["id"] for u in b["units"][:16]] == [u["id"] for u in a["units"][-16:]] for a, b in zip(found, found[1:], strict=False))
    ids, mask = sw.model_input(F.col("w.units"), 0, 2, 1)
    for r in df.select(F.explode(sw.windows(F.col("units"))).alias("w")).select(ids.alias("i"), mask.alias("m"), F.size("w.units").alias("n")).collect():
        assert len(r["i"]) == len(r["m"]) == 512 and r["i"][0] == 0 and r["i"][r["n"] + 1] == 2 and sum(r["m"]) == r["n"] + 2


def kept_of(messages, most):
    if len(messages) <= most:
        return messages
    last = messages[-(most - 1) :]
    if last[0][1] == "result":
        for m in reversed(messages[1 : len(messages) - len(last)]):
            if m[1] == "call" and m[2] is not None and m[2] == last[0][2]:
                last = [m, *last]
                break
    return [messages[0], *last]


def test_pruned_conversations(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 16)):
            rows.append((conv, turn, rng.choice(["call", "result", "text"]), rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "conv_id int, turn int, kind string, call_id string")
    got = sorted(map(repr, map(tuple, pruned(df, 6).collect())))
    want = [r for conv in {r[0] for r in rows} for m in [[(t, k, c) for x, t, k, c in rows if x == conv]] for r in [(conv, *x) for x in kept_of(m, 6)]]
    # A call that is the first message is kept as such.
    assert got == sorted(map(repr, want))
    assert pruned(df.limit(0)).count() == 0


def nested(rows):
    tree = {}
    for path, value in sorted(rows):
        at = tree
        *way, leaf = path.split(".")
        for x in way:
            if not isinstance(at.get(x), dict):
                at[x] = {}
            at = at[x]
        at[leaf] = value
    return tree


def merged(a, b):
    out = dict(a)
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        elif not isinstance(v, dict):
            out[k] = v
        elif (branch := merged(out[k] if isinstance(out.get(k), dict) else {}, v)) or isinstance(out.get(k), dict):  # what takes away something that isn't there changes nothing
            out[k] = branch
    return out


def leaves(tree, at=()):
    return {p for k, v in tree.items() for p in (leaves(v, (*at, k)) if isinstance(v, dict) else [(".".join((*at, k)), v)])}


def test_settings_are_merged_as_trees(spark):
    rng = random.Random(10)
    path = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    built, own = {}, {}
    for t in range(12):
        for _ in range(5):
            p = path()
            if not any(q != p and (q.startswith(p + ".") or p.startswith(q + ".")) for q in built.get(t, {})):
                built.setdefault(t, {})[p] = f"b{rng.randint(0, 99)}"
            p = path()
            if not any(q != p and (q.startswith(p + ".") or p.startswith(q + ".")) for q in own.get(t, {})):
                own.setdefault(t, {})[p] = rng.choice([None, f"u{rng.randint(0, 99)}"])
    a = spark.createDataFrame([(str(t), p, v) for t, x in built.items() for p, v in x.items()], st.SETTINGS)
    b = spark.createDataFrame([("me", str(t), p, v) for t, x in own.items() for p, v in x.items()] + [(None, "1", "a", "x"), ("me", None, "a", "x"), ("me", "own", "x.y", "1")], f"user_id string, {st.SETTINGS}")
    got = {}
    for r in st.layered(a, b).collect():
        got.setdefault(r["type_id"], set()).add((r["path"], r["value"]))
    for t in own:
        assert got.get(str(t), set()) == leaves(merged(nested(built.get(t, {}).items()), nested(own[t].items()))), t
    assert got["own"] == {("x.y", "1")}
    assert st.layered(a, b.limit(0)).count() == 0


def test_prompts(spark):
    rows = [("u", "t", "preface", "A note."), ("u", "t", "instructions.b", "short"), ("u", "t", "instructions.a", "plain"), ("u", "t", "sliders.detail", "5"), ("u", "t", "sliders.tone", "3"), ("u", "t", "other", "x")]
    docs = [("u", "t", "Two", 2), ("u", "t", None, 1), ("u", "none", "One", 1)]
    out = st.prompts(spark.createDataFrame(rows, "user_id string, type_id string, path string, value string"), spark.createDataFrame(docs, "user_id string, type_id string, title string, at int"))
    assert {r["type_id"]: r["prompt"] for r in out.collect()} == {"t": "A note.\n- plain\n- short\ndetail: far more\nDocuments:\n1. untitled\n2. Two", "none": ""}


def test_versions_equal_a_replay(spark):
    rng = random.Random(12)
    rows = [(s, at, rng.choice(["draft", "save", "save", "describe", "delete", "clear", "other"]), rng.choice([1, 2, None]), f"v{at}") for s in ("a", None, "b") for at in range(120)]
    df = spark.createDataFrame(rows, ve.CHANGES)
    got = {}
    for r in ve.state_at(ve.versions(df), df.select("session_id", "at")).collect():
        got.setdefault((r["session_id"], r["at"]), set()).add((r["item"], r["doc_id"], r["text"]))
    state = {}
    for s, at, kind, doc, text in rows:
        draft, saved, told = state.get(s, (None, {}, {}))
        saved, told = dict(saved), dict(told)
        if kind == "draft":
            draft = (doc, text)
        elif kind == "clear":
            draft = None
        elif kind == "save" and draft and draft[0] == doc:
            saved[doc] = draft[1]
        elif kind == "describe" and doc in saved:
            told[doc] = text
        elif kind == "delete":
            saved.pop(doc, None)
            told.pop(doc, None)
        state[s] = (draft, saved, told)
        want = ({("draft", *draft)} if draft else set()) | {("saved", d, t) for d, t in saved.items()} | {("described", d, t) for d, t in told.items()}
        assert got.get((s, at), set()) == want, (s, at)
    assert ve.versions(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("line", "runs"),
    [
        ("a **b** c", [("strong", "b")]), ("*a* _b_ ***c***", [("emphasis", "a"), ("emphasis", "b"), ("strong emphasis", "c")]), ("**a *b* c**", [("strong", "a *b* c"), ("emphasis", "b")]),
        ("snake_case_name and [PERSON_A_FIRST] _x_", [("emphasis", "x")]), ("`a *b*` ``c ` d``", [("code", "a *b*"), ("code", "c ` d")]), ("** a** and **", []), ("*a **b* c**", [("emphasis", "a **b")]),
        ("****", []), ("2 * 3 * 4", []), ("", []), ("[*a*](b) *c*", [("emphasis", "c")]), ("[ *a*", [("emphasis", "a")]), ("__é😀__ x", [("strong", "é😀")]),
    ],
)
def test_runs_by_hand(line, runs):
    assert [(style, line[s:e]) for s, e, style in md.runs_of(line)] == runs


def test_blocks_by_hand(spark):
    text = "# One ##\n\npara\ngoes on\n\n- a\n  - b\n    1. c\n- d\n\n- e\n3. f\n| x | y |\n| - | - |\n***\n###### six\n####### seven\ttab"
    got = [(b, k, n, text[s:e]) for b, k, n, s, e in md.blocks_of(text)]
    assert got == [
        (0, "heading", 1, "One ##"), (1, "paragraph", 0, "para"), (1, "paragraph", 0, "goes on"), (2, "bullet", 1, "a"), (2, "bullet", 2, "b"), (2, "number", 3, "c"), (2, "bullet", 1, "d"), (2, "bullet", 1, "e"),
        (3, "number", 1, "f"), (4, "table", 0, "| x | y |"), (4, "table", 0, "| - | - |"), (5, "rule", 0, "***"), (6, "heading", 6, "six"), (7, "paragraph", 0, "####### seven\ttab"),
    ]
    df = spark.createDataFrame([(text, 1), (None, 2), ("", 3)], "text string, runs int")
    assert [len(r["blocks"]) for r in md.with_markdown(df).collect()] == [14, 0, 0]
