"""Edits of codes: numbers that never go back, logs replayed in order, chains of merges; and searches for many words, against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sealgrove.functions import codes as c
from sealgrove.functions.words import PREFIXES
from sealgrove.operators import edits as ed
from sealgrove.operators.dictionary import Words, folded, seen_terms, with_hits
from sealgrove.operators.edit_log import LOG, chained, counters, replayed

CODES = "session_id string, key string, original string, type string, code string, base_id string, variant string, anchor boolean"


def row(session, key, base, type="contact", original=None, variant=None, anchor=False):
    return (session, key, original or key.upper(), type, f"[{base}{'_' + variant if variant else ''}]", base, variant, anchor)


def pairs(df, *columns):
    return {tuple(r[:-1]): r[-1] for r in df.select(*columns).collect()}


def test_letter_index(spark):
    ns = [0, 25, 26, 701, 702, 18277, 18278, 12356629]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select(c.letter_index(c.letters(F.col("n"))).alias("x")).collect()
    assert [r["x"] for r in got] == ns == [c.index_of(c.letters_of(n)) for n in ns]
    assert spark.createDataFrame([("a",), ("",), ("A1",), (None,)], "x string").select(c.letter_index(F.col("x")).alias("n")).distinct().collect()[0]["n"] is None


def test_a_number_in_use_is_not_dealt(spark):
    """CONTACT_A has gone; the next contact takes neither B, which another has, nor, with the counters of before, any that was in use."""
    codes = spark.createDataFrame([row("s", "a", "CONTACT_A"), row("s", "b", "CONTACT_B"), row("s", "d", "CONTACT_C"), row("s", "x", "ID_A", "identifier"), row(None, "x", "ID_A", "identifier")], CODES)
    picks = spark.createDataFrame([("s", "x", "contact"), ("s", "x", "contact"), (None, "x", "contact")], "session_id string, key string, new_type string")
    left = ed.removed(codes, codes.filter("key = 'a'"))
    assert pairs(ed.reclassified_keys(left, picks).filter("key = 'x'"), "session_id", "code") == {("s",): "[CONTACT_D]", (None,): "[CONTACT_A]"}
    gone = ed.removed(codes, codes.filter("key in ('a', 'd')"))
    assert pairs(ed.reclassified_keys(gone, picks).filter("key = 'x'"), "session_id", "code")["s",] == "[CONTACT_C]"
    assert pairs(ed.reclassified_keys(gone, picks, counters(codes)).filter("key = 'x'"), "session_id", "code")["s",] == "[CONTACT_D]"
    assert ed.reclassified_keys(left, picks).groupBy("session_id", "key").count().filter("count > 1").isEmpty()


def test_groups_and_custom_terms_take_free_numbers(spark):
    codes = spark.createDataFrame([row("s", "a", "CONTACT_B"), row("s", "x", "ID_A", "identifier"), row("s", "y", "ID_B", "identifier")], CODES)
    picks = spark.createDataFrame([("s", "ID_A", "contact"), ("s", "ID_B", "contact")], "session_id string, base_id string, new_type string")
    assert pairs(ed.reclassified_groups(codes, picks), "key", "code") == {("a",): "[CONTACT_B]", ("x",): "[CONTACT_A]", ("y",): "[CONTACT_C]"}
    docs = spark.createDataFrame([("s", 1, "Call the Ward, or WARD 5.")], "session_id string, doc_id long, text string")
    terms = spark.createDataFrame([("s", " ward ", "contact"), ("s", "WARD", "date"), ("s", "absent", "contact"), ("s", "", "contact"), ("t", "ward", "contact")], "session_id string, term string, type string")
    got = ed.with_custom_terms(codes, docs, terms).filter("key = 'ward'").collect()
    assert [(r["session_id"], r["code"]) for r in got] == [("s", "[DATE_A]")]  # of equal terms the smallest counts: WARD, a date


def test_aliases_picked_twice(spark):
    codes = spark.createDataFrame([row("s", "jo", "PERSON_A", "person_other"), row("s", "al", "PERSON_B", "person_other"), row("s", "x", "PERSON_C", "person_other")], CODES)
    picks = spark.createDataFrame([("s", "x", "jo"), ("s", "x", "al")], "session_id string, alias string, primary string")
    out = ed.merged_aliases(codes, picks).filter("key = 'x'").collect()
    assert [r["base_id"] for r in out] == ["PERSON_B"]


def replay(codes, log):
    """The log's rules as a plain loop: {(session, key): (base, type)}."""
    sessions = {}
    for s, key, _, kind, _, base, *_ in codes:
        held, next_ = sessions.setdefault(s, ({}, {}))
        held[key] = (base, kind)
        prefix, letters = base.split("_")
        next_[prefix] = max(next_.get(prefix, 0), c.index_of(letters) + 1)
    for s, _, kind, key, _, type_, code, primary in sorted(log, key=lambda r: (str(r[0]), r[1])):
        held, next_ = sessions.setdefault(s, ({}, {}))
        base = code and code.strip("[]")
        if kind == "clear":
            sessions[s] = ({}, {})
        elif kind == "reclassify" or kind == "add" and key not in held:
            prefix = PREFIXES[type_]
            n = next_.get(prefix, 0)
            while f"{prefix}_{c.letters_of(n)}" in {b for b, _ in held.values()}:
                n += 1
            next_[prefix], held[key] = n + 1, (f"{prefix}_{c.letters_of(n)}", type_)
        elif kind == "set" or kind == "update" and key in held:
            held[key] = next((v for k, v in held.items() if v[0] == base and k != key), (base, type_))
        elif kind == "remove":
            held.pop(key, None)
        elif kind == "remove_group" and key in held:
            gone = held[key][0]
            for k in [k for k, v in held.items() if v[0] == gone]:
                del held[k]
        elif kind == "merge" and primary in held:
            held[key] = held[primary]
    return {(s, k): v for s, (held, _) in sessions.items() for k, v in held.items()}


def test_a_log_of_all_kinds(spark):
    rng = random.Random(3)
    kinds, weights = ["add", "set", "update", "reclassify", "remove", "merge", "clear", "remove_group", "unknown"], [6, 1, 1, 2, 3, 4, 0.03, 1, 1]
    codes, log = [], []
    for s in ("a", "b", None, "c"):
        codes += [row(s, f"k{i}", f"CONTACT_{c.letters_of(i)}") for i in range(4) if s != "b"]
        for at in range(400 if s != "c" else 0):
            kind, key, type_ = rng.choices(kinds, weights)[0], f"k{rng.randint(0, 12)}", rng.choice(["contact", "person_other", "date"])
            code = f"[{PREFIXES[type_]}_{c.letters_of(rng.randint(0, 40))}]" if kind in ("set", "update") else None
            log.append((s, at, kind, key, key.upper(), type_, code, f"k{rng.randint(0, 12)}" if kind == "merge" else None))
    out = replayed(spark.createDataFrame(codes, CODES), spark.createDataFrame(log, LOG).repartition(7))
    assert {(r["session_id"], r["key"]): (r["base_id"], r["type"]) for r in out.collect()} == replay(codes, log)


def test_merges_show_variants_of_the_primary(spark):
    log = [
        ("s", 1, "add", "sean michael versteegh", "Sean Michael Versteegh", "person_other", None, None), ("s", 2, "add", "sean", "Sean", "person_other", None, None),
        ("s", 3, "merge", "sean", "Sean", None, None, "sean michael versteegh"), ("s", 4, "merge", "mr versteegh", "Mr Versteegh", None, None, "sean"), ("s", 5, "merge", "x", "X", None, None, "nobody"),
    ]
    out = replayed(spark.createDataFrame([], CODES), spark.createDataFrame(log, LOG))
    assert {r["key"]: (r["code"], r["original"], r["anchor"]) for r in out.collect()} == {
        "sean michael versteegh": ("[PERSON_A_FULL]", "Sean Michael Versteegh", True), "sean": ("[PERSON_A_FIRST]", "Sean", False), "mr versteegh": ("[PERSON_A_FORMAL]", "Mr Versteegh", False)}
    assert replayed(spark.createDataFrame([], CODES), spark.createDataFrame([], LOG)).count() == 0


def ends(links):
    first = {}
    for s, a, p in links:
        if a is not None and p is not None and a != p:
            first[s, a] = min(first.get((s, a), p), p)
    out = {}
    for s, a in first:
        way = [a]
        while (s, way[-1]) in first:
            x = first[s, way[-1]]
            if x in way:
                way.append(min(way[way.index(x) :]))
                break
            way.append(x)
        if way[-1] != a:
            out[s, a] = way[-1]
    return out


def test_chains_and_circles(spark):
    rng = random.Random(1)
    links = [("c", f"n{i:04d}", f"n{i + 1:04d}") for i in range(1000)]
    links += [(None, "a", "b"), (None, "b", "c"), (None, "c", "a"), (None, "d", "a"), ("x", "q", "q"), ("x", None, "q"), ("x", "q", "r"), ("x", "q", "p"), ("x", "q", "p")]
    links += [("r", f"m{rng.randint(0, 60)}", f"m{rng.randint(0, 60)}") for _ in range(80)]
    out = chained(spark.createDataFrame(links, "session_id string, alias string, primary string"))
    assert pairs(out, "session_id", "alias", "primary") == ends(links)
    assert chained(spark.createDataFrame([], "session_id string, alias string, primary string")).count() == 0


def brute(words, text):
    """Each word's hits from left to right, in lower case."""
    out = []
    for word, type_ in words:
        at = folded(text).find(folded(word))
        while at >= 0:
            out.append((at, at + len(word), text[at : at + len(word)], type_))
            at = folded(text).find(folded(word), at + len(word))
    return sorted(out)


def test_many_words(spark):
    rng = random.Random(2)
    words = sorted({("".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))), rng.choice(["date", "contact"])) for _ in range(60)})
    words = list({folded(w): (w, t) for w, t in reversed(words)}.values())
    texts = ["".join(rng.choice("aAbBcÉ é") for _ in range(rng.randint(0, 60))) for _ in range(50)] + [None, "", "İstanbul ΣΟΦΟΣ aaaa", "x" * 100_000 + "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in with_hits(df, Words(words)).collect():
        assert sorted((h["s"], h["e"], h["text"], h["type"]) for h in r["hits"]) == (brute(words, r["text"]) if r["text"] else [])


@pytest.mark.parametrize("words", [[], [(None, "date"), ("", "date"), ("  ", "date")]])
def test_no_words(spark, words):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    assert all(not r["hits"] for r in with_hits(df, Words(words)).collect())


def test_hits_replace_a_column_and_obey_exclusions(spark):
    df = spark.createDataFrame([("Ward ward", 1)], "text string, HITS int")
    out = with_hits(df, Words([("ward", "date"), ("WARD ", "contact"), ("war", "identifier")]), excluded=("WAR",))
    assert out.columns == ["text", "hits"] and [(h["s"], h["type"], h["confidence"]) for h in out.first()["hits"]] == [(0, "contact", 1.0), (5, "contact", 1.0)]


def test_time_hardly_depends_on_the_number_of_words(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(20_000))
    took = []
    for n in (100, 100_000):
        words = Words(("".join(rng.choice("klmnopqrst") for _ in range(8)), "date") for _ in range(n))
        words.find("warm")
        began = time.time()
        for _ in range(5):
            words.find(text)
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_terms_of_sessions(spark):
    docs = spark.createDataFrame([("s", "Ward 5 and Otahuhu"), ("t", "ward"), (None, "otahuhu"), ("s", None)], "session_id string, text string")
    terms = spark.createDataFrame([("s", "ward"), ("s", "otahuhu"), ("s", "no"), ("t", "otahuhu"), (None, "otahuhu")], "session_id string, key string")
    found = {tuple(r) for r in seen_terms(docs, terms).collect()}
    assert found == {("s", "ward"), ("s", "otahuhu"), ("t", "ward"), (None, "otahuhu")}
