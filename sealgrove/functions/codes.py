"""Placeholder codes: letters, code text, base and variant of a code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealgrove.functions.words import PREFIXES, VARIANTS

#: [PREFIX_LETTERS] or [PREFIX_LETTERS_VARIANT], and a date's with the year that was kept behind it.
PLACEHOLDER = r"\[DATE_[A-Z]+\] (?:19|20)\d{2}|\[[A-Z]+_[A-Z]+(?:_[A-Z]+)*\]"
CODE = r"\[([A-Z]+_[A-Z]+)\]"
#: A placeholder without a year: what is behind a date's code holds no other.
BARE = r"\[[A-Z]+_[A-Z]+(?:_[A-Z]+)*\]"
_SUFFIXES = "|".join(sorted(VARIANTS, key=len, reverse=True))


def codes_in(text: Column) -> Column:
    """The codes of a text's placeholders, each once; null of null."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(BARE), F.lit(0)))


def letters(n: Column) -> Column:
    """0, 1, ... as A, ..., Z, AA, AB, ...: up to seven letters, which take any int; greater and negative numbers raise an error. Null stays null."""
    n = n.cast("long")
    char = lambda x: F.chr(F.lit(65) + x.cast("long"))
    out, first, width = F.when(n < 0, F.raise_error(F.concat(F.lit("no letters for "), n))), 0, 1
    while width <= 7:
        rest = n - first
        text = F.concat(*(char(F.expr("0") + F.floor(rest / 26**k) % 26) for k in range(width - 1, -1, -1)))
        out = out.when(n < first + 26**width, text)
        first += 26**width
        width += 1
    return out.when(n.isNotNull(), F.raise_error(F.concat(F.lit("no letters for "), n)))


def letters_of(n: int) -> str:
    """`letters` of a plain number."""
    out = ""
    while n >= 0:
        n, k = divmod(n, 26)
        out, n = chr(65 + k) + out, n - 1
    return out


def index_of(letters: str) -> int:
    """The inverse of `letters_of`."""
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n - 1


def letter_index(letters: Column) -> Column:
    """The inverse of `letters`: null for anything but one to twelve capitals."""
    known = letters.rlike("^[A-Z]{1,12}$")
    return F.when(known, F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64)) - 1)


def base_id(type: Column, n: Column) -> Column:
    """PREFIX_LETTERS of the n-th of a type; an unknown type raises an error, as its mention would stay unredacted."""
    prefix = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    known = F.coalesce(F.try_element_at(prefix, type), F.raise_error(F.concat(F.lit("no prefix for type "), F.coalesce(type, F.lit("null")))).cast("string"))
    return F.concat(known, F.lit("_"), letters(n))


def with_variant(base: Column, variant: Column) -> Column:
    """A code in brackets: of a base alone, or with a variant."""
    return F.concat(F.lit("["), F.concat_ws("_", base, variant), F.lit("]"))


def code(type: Column, n: Column) -> Column:
    return with_variant(base_id(type, n), F.lit(None).cast("string"))


def base_of(code: Column) -> Column:
    """A code without brackets and variant."""
    return F.regexp_extract(code, rf"^\[?([A-Z]+_[A-Z]+?)(?:_(?:{_SUFFIXES}))?\]?$", 1)


def variant_of(code: Column) -> Column:
    """A code's variant, or null."""
    v = F.regexp_extract(code, rf"^\[?[A-Z]+_[A-Z]+?_({_SUFFIXES})\]?$", 1)
    return F.when(v != "", v)


def year_of(text: Column) -> Column:
    y = F.regexp_extract(text, r"\b(?:19|20)\d{2}\b", 0)
    return F.when(y != "", y)


def rendered(code: Column, type: Column, text: Column, keep_year: bool = True) -> Column:
    """What stands for a mention: its code, and a date's year behind it."""
    return F.when((type == "date") & year_of(text).isNotNull(), F.concat(code, F.lit(" "), year_of(text))).otherwise(code) if keep_year else code
