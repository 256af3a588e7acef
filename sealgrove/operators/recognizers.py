"""Recognizers: rows of patterns, scanned in one pass over the texts, lists of the user's words, and a plug-in protocol for models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealgrove.functions import words as w
from sealgrove.functions.scan import MENTIONS, marked, scannable, spans_of
from sealgrove.operators.dictionary import Words, with_hits
from sealgrove.operators.plain import common, with_plain
from sealgrove.operators.spans import without_overlaps

MODEL_MENTIONS = "doc_id long, s int, e int, text string, type string, confidence double, rec_ord int, pat_ord int"


@dataclass(frozen=True)
class Rule:
    """A pattern of a recognizer; rec_ord and pat_ord break ties between equal spans."""

    name: str
    rec_ord: int
    pat_ord: int
    pattern: str
    type: str
    confidence: float
    group: int = 0
    #: Matches whose lower-case text is one of these are dropped.
    drop: tuple[str, ...] = ()
    #: A cheap condition on the text that every match needs.
    needs: str | None = None


def _any(items: list[str]) -> str:
    return "|".join(items)


_NAME = r"[A-Z][a-z]+"
_MONTHS, _SHORT = _any(w.MONTHS), _any(w.SHORT_MONTHS)

# Patterns, types and confidences, in order of registration.
RULES: tuple[Rule, ...] = (
    Rule("email", 0, 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "contact", 0.95, needs="@"),
    Rule("phone_mobile", 1, 0, r"\b0(21|22|27|29)[\s-]?\d{3}[\s-]?\d{4}\b", "contact", 0.95, needs="0"),
    Rule("phone_landline", 1, 1, r"\b0[3-9][\s-]?\d{3}[\s-]?\d{4}\b", "contact", 0.9, needs="0"),
    Rule("phone_international", 1, 2, r"\+64[\s-]?\d{1,2}[\s-]?\d{3}[\s-]?\d{4}\b", "contact", 0.95, needs="+64"),
    Rule("phone_free", 1, 3, r"\b0800[\s-]?\d{3}[\s-]?\d{3}\b", "contact", 0.9, needs="0800"),
    Rule("id_nhi", 2, 0, r"\b[A-Z]{3}\d{4}\b", "identifier", 0.85),
    Rule("id_acc", 2, 1, r"\bACC\s?\d{5,}\b", "identifier", 0.9, needs="ACC"),
    Rule("id_record", 2, 2, r"\b(?:MRN|Case|ID)\s*[:#]?\s*[A-Z0-9-]{4,}\b", "identifier", 0.8),
    Rule("id_dashed", 2, 3, r"\b(?:MR|CR|UR)-\d{5,}\b", "identifier", 0.85, needs="R-"),
    Rule("id_alnum", 2, 4, r"(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9][A-Za-z0-9-]{2,}[A-Za-z0-9]", "identifier", 0.7),
    Rule("date_slash", 3, 0, r"\b\d{1,2}/\d{1,2}/\d{4}\b", "date", 0.95, needs="/"),
    Rule("date_dash", 3, 1, r"\b\d{1,2}-\d{1,2}-\d{4}\b", "date", 0.95, needs="-"),
    Rule("date_iso", 3, 2, r"\b\d{4}-\d{1,2}-\d{1,2}\b", "date", 0.95, needs="-"),
    Rule("date_month_day", 3, 3, rf"\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", "date", 0.95),
    Rule("date_day_month", 3, 4, rf"\b\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\b", "date", 0.95),
    Rule("date_day_mon", 3, 5, rf"\b\d{{1,2}}\s+(?:{_SHORT})\s+\d{{4}}\b", "date", 0.9),
    Rule("place_street", 4, 0, rf"\d+\s+{_NAME}(?:\s+{_NAME})*\s+(?:{_any(w.STREETS)})\b", "location", 0.9),
    Rule("place_suburb", 4, 1, rf"\b(?:{_any(w.SUBURBS)})\b", "location", 0.95),
    Rule("place_city", 4, 2, rf"\b(?:{_any(w.CITIES)})\b", "location", 0.95),
    Rule("place_hospital", 4, 3, rf"\b(?:{_any(w.HOSPITALS)})\s+Hospital\b", "location", 0.95, needs="Hospital"),
    Rule("place_board", 4, 4, rf"\b(?:{_any(w.BOARDS)})\s+(?:DHB|District Health Board|Clinic)\b", "organization", 0.9),
    Rule("known_name", 5, 0, rf"(?i)\b(?:{_any(sorted(dict.fromkeys(w.FIRST_NAMES + w.LAST_NAMES)))})\b", "person_other", 0.95),
    Rule("relation_name", 6, 0, rf"(?i)\b(?:{_any(w.RELATIONSHIPS)})(?-i)\s+({_NAME}(?:\s+{_NAME})?)", "person_other", 0.9, 1, tuple(w.COMMON)),
    Rule("relation_word", 6, 1, rf"(?i)\b(?:{_any(w.RELATIONSHIPS)})(?-i)\s+({_NAME})", "person_other", 0.85, 1, tuple(w.COMMON)),
    Rule("title_name", 7, 0, rf"\b(?:{_any(w.TITLES)})\.?\s+({_NAME}(?:\s+{_NAME}){{0,2}})", "person_other", 0.9, 1, tuple(w.COMMON)),
    Rule("numbers_joined", 10, 0, r"\b\d{2,}(?:[/\-.,]\d+)*\b", "numeric_all", 0.75),
    Rule("numbers_spaced", 10, 1, r"\b\d{2,}(?:\s\d+)+\b", "numeric_all", 0.75),
    Rule("numbers_short", 10, 2, r"\b\d[/\-]\d+(?:[/\-]\d+)*\b", "numeric_all", 0.75),
    Rule("numbers_long", 10, 3, r"\b\d{4,}\b", "numeric_all", 0.7),
)
# Rules of the model-assisted pass.
MODEL_RULES: tuple[Rule, ...] = (
    Rule("model_identifier", 12, 0, r"\b[A-Za-z0-9][A-Za-z0-9\-]{3,}[A-Za-z0-9]\b", "identifier", 0.9),
    Rule("double_capital", 12, 1, r"\b[A-Z]{2}[a-z]{2,}\b", "person_other", 0.75, drop=tuple(w.CLINICAL)),
)
BY_NAME = {r.name: r for r in (*RULES, *MODEL_RULES)}


def inclusion_rule(words: list[str | tuple[str, str]], type: str = "person_other") -> Words:
    """The user's words, alone or with a type each, to be looked for beside rules: found anywhere, in any case."""
    return Words((x, type) if isinstance(x, str) else x for x in words if x)


def _trie(words: list[str]) -> str:
    """A pattern of some words in which those of equal beginnings share it."""
    tails: dict[str, list[str]] = {}
    for x in words:
        tails.setdefault(x[:1], []).append(x[1:])
    ends, parts = "" in tails, [x + _trie(own) for x, own in tails.items() if x]
    return "" if not parts else parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)}){'?' if ends else ''}"


def factored(pattern: str) -> str:
    """The pattern with its lists of eight words or more as tries, as a list is tried word by word at each place of a text.

    Only lists behind which no letter may follow, and of which no word goes on behind another one's end: at a place at most one word matches, so that their order tells nothing.
    """

    def one(m: re.Match) -> str:
        words = m[1].split("|")
        low = {x.lower() for x in words}
        alone = all(x[:k] not in low for x in low for k in range(1, len(x)) if not (x[k].isascii() and x[k].isalnum()))
        return f"(?:{_trie(words)})" if alone else m[0]

    return re.sub(r"\(\?:([\w' -]+(?:\|[\w' -]+){7,})\)(?=\\b|(?:\(\?-i\))?(?:\\\.\?)?\\s)", one, pattern)


def marked_by(rule: Rule, text: Column) -> Column:
    """A scannable text with marks around the rule's matches; null where it can have none."""
    out = marked(text, factored(rule.pattern), rule.group)
    return F.when(F.contains(text, F.lit(rule.needs)), out) if rule.needs else out


def _dropped(rule: Rule, exclude: tuple[str, ...]) -> tuple[str, ...]:
    return (*rule.drop, *((x.strip().lower() for x in exclude if x) if rule.rec_ord in (5, 7) else ()))


def _searched_whole(rule: Rule) -> bool:
    """Whether plain texts are searched by batches; rules that look into their matches aren't."""
    return rule.name not in ("double_capital", "model_identifier") and common(factored(rule.pattern))


def _row_of(rule: Rule, exclude: tuple[str, ...]) -> tuple:
    """The rule as `with_plain` takes it."""
    return factored(rule.pattern), rule.group, _dropped(rule, exclude), rule.type, rule.confidence, rule.rec_ord, rule.pat_ord


def found_by(rule: Rule, found: Column, exclude: tuple[str, ...] = ()) -> Column:
    """The rule's mentions in a text that it has marked, as MENTIONS. `exclude`: the user's excluded words, for names."""
    spans = spans_of(found, rule.group)
    if drop := _dropped(rule, exclude):
        spans = F.filter(spans, lambda x: ~F.lower(x["t"]).isin(*drop))
    if rule.name == "double_capital":
        spans = F.filter(spans, lambda x: ~F.substring(x["t"], 1, 2).isin(*w.CAPITAL_PREFIXES))
    if rule.name == "model_identifier":
        spans = F.filter(spans, lambda x: x["t"].rlike("[A-Za-z]") & x["t"].rlike("[0-9]") & ~F.lower(x["t"]).isin(*w.ABBREVIATIONS))
    out = F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("text"), F.lit(rule.type).alias("type"), F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.rec_ord).alias("rec_ord"), F.lit(rule.pat_ord).alias("pat_ord")))
    return F.when(F.contains(found, F.lit("\x01")), out).otherwise(F.array().cast(MENTIONS))


def detect(df: DataFrame, rules: tuple[Rule | Words, ...] = RULES, text: str = "text", exclude: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `mentions`: what all rules and word lists find, in one pass without a shuffle; plain texts are searched by batches, others by native expressions.

    `exclude`: the user's excluded words, in any case. They hold for known names, names behind titles and the word lists.
    """
    lists = {f"_words{k}": r for k, r in enumerate(r for r in rules if isinstance(r, Words))}
    for name, words in lists.items():
        df = with_hits(df, words, text, name, exclude)
    patterns = {f"_marked{k}": r for k, r in enumerate(r for r in rules if isinstance(r, Rule))}
    whole = {name: r for name, r in patterns.items() if _searched_whole(r)}
    if whole:
        df = with_plain(df, [_row_of(r, exclude) for r in whole.values()], text, "_plain")
        df = df.withColumn("_rest", F.when(F.col("_plain").isNull(), scannable(F.col(text))))
    if len(whole) < len(patterns):
        df = df.withColumn("_scan", scannable(F.col(text)))
    marks = df.withColumns({name: marked_by(r, F.col("_rest" if name in whole else "_scan")) for name, r in patterns.items()}) if patterns else df  # columns of their own, as they are read more than once
    found = {name: found_by(r, F.col(name), exclude) for name, r in patterns.items()}
    plain = [F.coalesce("_plain", F.flatten(F.array(*(found[name] for name in whole))))] if whole else []
    every = [*plain, *(x for name, x in found.items() if name not in whole), *map(F.col, lists)]
    return marks.withColumn("mentions", every[0] if plain and len(every) == 1 else F.flatten(F.array(*every))).drop("_scan", "_rest", "_plain", *patterns, *lists)


def settled(df: DataFrame, rules: tuple[Rule | Words, ...] = RULES, text: str = "text", exclude: tuple[str, ...] = ()) -> DataFrame:
    """`detect` without overlaps, and without the text, which other columns are to be made from before. Where all rules are searched for by batches, plain texts' overlaps are settled there, too."""
    if not all(isinstance(r, Rule) and _searched_whole(r) for r in rules) or not rules:
        return detect(df, rules, text, exclude).withColumn("mentions", without_overlaps(F.col("mentions"))).drop(text)
    df = with_plain(df, [_row_of(r, exclude) for r in rules], text, "_plain", apart=True).withColumn("_rest", scannable(F.col(text)))
    marks = df.withColumns({f"_marked{k}": marked_by(r, F.col("_rest")) for k, r in enumerate(rules)})
    native = without_overlaps(F.flatten(F.array(*(found_by(r, F.col(f"_marked{k}"), exclude) for k, r in enumerate(rules)))))
    return marks.withColumn("mentions", F.coalesce("_plain", native)).drop(text, "_rest", "_plain", *(f"_marked{k}" for k in range(len(rules))))


def mentions(df: DataFrame, rules: tuple[Rule | Words, ...] = RULES, keys: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """A row for each mention, with the document's keys.

    From `explode` of a column Spark infers a filter by it, and pushes that to where all rules, and what the text is made of, are computed again for each use; from `explode_outer` it infers none.
    """
    read = [c for c in df.columns if c in (*keys, options.get("text", "text"))]
    return detect(df.select(*read), rules, **options).select(*keys, F.explode_outer("mentions").alias("m")).filter("m is not null").select(*keys, "m.*")


def plugged_in(df: DataFrame, recognize: Callable[[str], list[tuple[int, int, str, str, float]]], rec_ord: int = 9, load: Callable[[], object] | None = None) -> DataFrame:
    """Mentions that a model finds: `recognize(text)` gives (start, end, text, type, confidence). `load` runs once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load() if load else None
        for frame in frames:
            rows = []
            for i, t in zip(frame["doc_id"], frame["text"], strict=True):
                got = recognize(t or "") if model is None else recognize(t or "", model)
                rows += [(i, *m, rec_ord, k) for k, m in enumerate(got)]
            yield pd.DataFrame(rows, columns=["doc_id", "s", "e", "text", "type", "confidence", "rec_ord", "pat_ord"])

    return df.select("doc_id", "text").mapInPandas(run, MODEL_MENTIONS)
