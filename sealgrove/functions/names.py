"""Parts and variants of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that are taken off a name, with or without a dot.
NAME_TITLES = "mr mrs ms dr prof miss mr. mrs. ms. dr. prof.".split()
# Prefixes that models put before a name.
MODEL_TITLES = ["Dr.", "Dr ", "Mr.", "Mr ", "Mrs.", "Mrs ", "Ms.", "Ms ", "Prof.", "Prof ", "Professor "]


def tokens(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda x: x != "")


def has_title(name: Column) -> Column:
    return F.lower(name).rlike("^(?:" + "|".join(t.replace(".", "\\.") for t in NAME_TITLES) + ") ")


def strip_title(name: Column) -> Column:
    t = tokens(name)
    titled = (F.size(t) > 0) & F.lower(F.get(t, F.lit(0))).isin(*NAME_TITLES)
    return F.when(titled, F.array_join(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), " ")).otherwise(name)


def title_of(name: Column) -> Column:
    first = F.get(tokens(name), F.lit(0))
    return F.when(F.lower(first).isin(*NAME_TITLES), F.initcap(F.replace(first, F.lit("."), F.lit(""))))


def person(name: Column) -> dict[str, Column]:
    """Title, first, last and middle part of a full name; a single token is both first and last."""
    t = tokens(strip_title(name))
    n = F.size(t)
    middle = F.when(n > 2, F.array_join(F.slice(t, 2, F.greatest(n - 2, F.lit(0))), " "))
    return {"title": title_of(name), "first": F.get(t, F.lit(0)), "last": F.element_at(t, F.lit(-1)), "middle": middle}


def variants(p: dict[str, Column], full: Column) -> dict[str, Column]:
    """The text of each variant of a person."""
    first_last = F.when(F.coalesce(p["last"], F.lit("")).isin("") | (p["last"] == p["first"]), p["first"]).otherwise(F.concat_ws(" ", p["first"], p["last"]))
    return {
        "FULL": full, "FIRST_LAST": first_last, "FIRST": p["first"], "LAST": p["last"], "MIDDLE": F.coalesce(p["middle"], p["first"]),
        "FORMAL": F.concat_ws(" ", F.coalesce(p["title"], F.lit("Mr")), p["last"]), "FIRST_MID": F.concat_ws(" ", p["first"], p["middle"]),
    }


def variant_for(alias: Column, p: dict[str, Column], full: Column) -> Column:
    """Which variant of the person an alias is: exact forms first, then a prefix of at least three letters of the first name, or null."""
    x, v = F.lower(strip_title(alias)), {k: F.lower(c) for k, c in variants(p, full).items()}
    near = (F.length(x) >= 3) & (F.startswith(v["FIRST"], x) | F.startswith(x, v["FIRST"]))
    return (
        F.when(x == v["FULL"], "FULL").when(p["middle"].isNotNull() & (x == v["FIRST_MID"]), "FIRST_MID").when(x == v["FIRST_LAST"], "FIRST_LAST")
        .when(has_title(alias) & (x == v["LAST"]), "FORMAL").when(x == v["FIRST"], "FIRST").when(x == F.lower(p["middle"]), "MIDDLE").when(x == v["LAST"], "LAST").when(near, "FIRST")
    )
