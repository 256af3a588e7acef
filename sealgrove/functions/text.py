"""Counts, estimates, prompts, formats and paths of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealgrove.functions.names import MODEL_TITLES

#: From so many characters on a text is read through memory files; a summary's request takes so many.
LONG_TEXT, HEAD = 100_000, 50_000
# The lines of a prompt that hold its style.
STYLE = ("Tone: {formality_text}", "Detail: {detail_text}", "Structure: {structure_text}")


def occurrences_of(text: Column, part: str) -> Column:
    """How often a part occurs, without overlaps; an empty part never does."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long") if part else F.lit(0).cast("long")


def occurrences_of_column(text: Column, part: Column) -> Column:
    """The same for a part that is a column."""
    return F.when(part == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("long")


def dense_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"\s", "")).cast("long")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def summary_points(text: Column) -> Column:
    """How many points a summary of a text is asked for."""
    return F.greatest(F.lit(10), F.least(F.lit(50), F.floor(F.length(text) / 10000) * 10 + 10)).cast("long")


def seconds_estimate(words: Column, mode: str) -> Column:
    """Estimated seconds: patterns take one, a model thirty and one for 3.5 words, both five more."""
    model = 30 + F.floor(words / 3.5)
    return {"patterns": F.lit(1), "model": F.greatest(model, F.lit(15)), "both": F.greatest(model + 5, F.lit(20))}[mode].cast("long")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced, in the order of the values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t")) == ""


def without_style(template: Column) -> Column:
    """A template without the lines of its style; runs of blank lines become one."""
    bare = lambda x: F.btrim(x, F.lit(" \t"))
    kept = F.filter(F.split(template, "\n"), lambda x: ~(F.startswith(bare(x), F.lit(STYLE[0])) | F.startswith(bare(x), F.lit(STYLE[1])) | F.startswith(bare(x), F.lit(STYLE[2]))))
    numbered = F.transform(kept, lambda x, i: F.struct(x.alias("x"), (F.coalesce(_blank(F.get(kept, i - 1)), F.lit(False)) & _blank(x)).alias("again")))
    return F.array_join(F.transform(F.filter(numbered, lambda n: ~n["again"]), lambda n: n["x"]), "\n")


def with_style(template: Column) -> Column:
    """A template with the lines of its style after its first line that isn't blank."""
    lines = F.split(template, "\n")
    flags = F.transform(lines, lambda x: ~_blank(x))
    at = F.when(F.array_contains(flags, True), F.array_position(flags, True).cast("int")).otherwise(F.lit(1))
    style = F.array(*(F.lit(x) for x in ("", *STYLE, "")))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), at), style, F.slice(lines, at + 1, F.size(lines))), "\n")


def strip_model_title(name: Column) -> Column:
    """A name without the title that a model put before it."""
    pattern = "(?i)^(?:" + "|".join(t.replace(".", r"\.") for t in MODEL_TITLES) + ")"
    return F.when(name.rlike(pattern), F.btrim(F.regexp_replace(name, pattern, ""), F.lit(" \t"))).otherwise(name)


def shown_seconds(x: Column) -> Column:
    return F.format_string("%.2f seconds", F.bround(x, 2))


def shown_share(x: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(x * 100, 1))


def shown_size(n: Column) -> Column:
    """Bytes, or kilobytes and megabytes with one digit."""
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1024 * 1024, F.format_string("%.1fK", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1fM", F.bround(n / (1024 * 1024), 1)))


def clean_path(path: Column) -> Column:
    """A path of a memory file without ways out of its folder, the folder's name and a leading slash."""
    for part in ("../", "..\\", "%2e%2e%2f", "%2E%2E%2F"):
        path = F.replace(path, F.lit(part), F.lit(""))
    return F.regexp_replace(F.regexp_replace(path, "^/memories/?", ""), "^/", "")


def block_kind(line: Column) -> Column:
    """What a line of Markdown is."""
    kinds = {"h3": "^### ", "h2": "^## ", "h1": "^# ", "rule": r"^(?:---+|\*\*\*+|___+)\s*$", "table": r"^\|", "callout": "^> ", "list": r"^\s*[-*•] ", "numbered": r"^\s*\d+\. ", "blank": r"^\s*$"}
    out = F
    for name, pattern in kinds.items():
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("text")
