"""Edits of codes, persons, exclusions and word lists as set operations: each takes all of a session's picks at once.

`codes` is the table of operators.entities. Numbers that are dealt anew go on behind the highest that a session has for the type, or from `next_` (session_id, prefix, next) on where that is
given, which keeps the numbers of codes that have gone from being dealt again: `edit_log.counters` of the codes before. Picks are dealt in the order of their keys; of several for one key the
smallest counts. Sessions may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.functions import codes as c
from sealgrove.functions import names as fn
from sealgrove.functions.words import VARIANTS
from sealgrove.operators.dictionary import seen_terms
from sealgrove.operators.edit_log import counters, prefix_of
from sealgrove.operators.edit_log import dealt as in_order
from sealgrove.operators.joins import joined

KEY = ("session_id", "key")


def upserted(rows: DataFrame, changes: DataFrame, keys: tuple[str, ...] = KEY, only_known: bool = False) -> DataFrame:
    """`rows` with those of the changes' keys replaced; with `only_known`, keys that aren't there yet stay out."""
    changes = changes.select(*rows.columns)
    if only_known:
        changes = joined(changes, rows.select(*keys).distinct(), keys, "left_semi")
    return joined(rows, changes.select(*keys), keys, "left_anti").unionByName(changes)


def removed(rows: DataFrame, picks: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return joined(rows, picks.select(*keys).distinct(), keys, "left_anti")


def with_unknown_placeholders(codes: DataFrame, found: DataFrame) -> DataFrame:
    """Codes, with those of found placeholders (session_id, code) that a session doesn't know: their original is empty, for the user to fill in."""
    new = joined(found.select("session_id", "code").distinct(), codes.select("session_id", "code"), ("session_id", "code"), "left_anti")
    new = new.select(
        "session_id", F.lower("code").alias("key"), F.lit("").alias("original"), F.lit(None).cast("string").alias("type"), "code",
        c.base_of(F.col("code")).alias("base_id"), c.variant_of(F.col("code")).alias("variant"), F.lit(False).alias("anchor"))
    return codes.unionByName(new)


def dealt(codes: DataFrame, new: DataFrame, next_: DataFrame | None = None) -> DataFrame:
    """`new` (session_id, type and other columns, `at` to order by) with a base_id each: the next free numbers of their types."""
    return in_order(new, next_ if next_ is not None else counters(codes), codes.select("session_id", "base_id").distinct()).drop("at")


def reclassified_keys(codes: DataFrame, picks: DataFrame, next_: DataFrame | None = None) -> DataFrame:
    """Codes after picks (session_id, key, new_type): the keys get the next codes of their new types, without a variant."""
    picks = picks.groupBy(*KEY).agg(F.min("new_type").alias("type"))
    own = joined(codes.select(*KEY, "original"), picks, KEY).withColumn("at", F.col("key"))
    own = dealt(codes, own, next_).withColumns({"variant": F.lit(None).cast("string"), "anchor": F.lit(False)}).withColumn("code", c.with_variant(F.col("base_id"), F.col("variant")))
    return upserted(codes, own)


def reclassified_groups(codes: DataFrame, picks: DataFrame, next_: DataFrame | None = None) -> DataFrame:
    """Codes after picks (session_id, base_id, new_type), for all codes of the bases: a base keeps its letters if no other of the new type has them.

    Of several picked bases with the same letters the first keeps them; the others get the next letters. Variants stay.
    """
    letters = F.substring_index("base_id", "_", -1)
    own = picks.groupBy("session_id", "base_id").agg(F.min("new_type").alias("new_type")).withColumn("want", F.concat(prefix_of(F.col("new_type")), F.lit("_"), letters))
    others = removed(codes, picks, ("session_id", "base_id")).select("session_id", F.col("base_id").alias("want"), F.lit(True).alias("_used")).distinct()
    nth = F.row_number().over(Window.partitionBy("session_id", "want").orderBy("base_id"))
    own = joined(own, others, ("session_id", "want"), "left").withColumn("_keeps", F.col("_used").isNull() & (nth == 1))
    kept = own.filter("_keeps").select("session_id", "base_id", "new_type", F.col("want").alias("_new"))
    rest = own.filter("not _keeps").select("session_id", F.col("base_id").alias("old"), F.col("new_type").alias("type"), F.col("base_id").alias("at"))
    wanted = kept.select("session_id", F.col("_new").alias("base_id"))  # what others keep is in use too
    rest = in_order(rest, next_ if next_ is not None else counters(codes), codes.select("session_id", "base_id").unionByName(wanted).distinct()).select("session_id", F.col("old").alias("base_id"), F.col("type").alias("new_type"), F.col("base_id").alias("_new"))
    moved = joined(codes, kept.unionByName(rest), ("session_id", "base_id"), "left")
    out = moved.withColumns({"type": F.coalesce("new_type", "type"), "base_id": F.coalesce("_new", "base_id")}).drop("new_type", "_new")
    return out.withColumn("code", c.with_variant(F.col("base_id"), F.col("variant"))).select(*codes.columns)


def merged_aliases(codes: DataFrame, picks: DataFrame) -> DataFrame:
    """Codes after picks (session_id, alias, primary), keys each: an alias takes its primary's base, and the text of that variant of the primary that it is.

    A primary that is no anchor becomes one: FULL with a middle name, else FIRST_LAST. An alias that is no variant of it counts as FIRST_LAST if it has
    several words, else as FIRST. Picks whose primary isn't there are ignored.
    """
    known = codes.select("session_id", F.col("key").alias("primary"), F.col("original").alias("_name"), F.col("base_id").alias("_base"), "type")
    rest = ["alias_text"] if "alias_text" in picks.columns else []
    picks = picks.groupBy("session_id", "alias").agg(F.min(F.struct("primary", *rest)).alias("x")).select("session_id", "alias", "x.*")
    own = joined(picks, known, ("session_id", "primary"))
    p = fn.person(F.col("_name"))
    text = F.coalesce("alias_text", "alias") if "alias_text" in picks.columns else F.col("alias")
    variant = F.coalesce(fn.variant_for(text, p, fn.strip_title(F.col("_name"))), F.when(F.contains(text, F.lit(" ")), "FIRST_LAST").otherwise("FIRST"))
    forms = fn.variants(p, fn.strip_title(F.col("_name")))
    original = F.element_at(F.create_map(*(x for k, v in forms.items() for x in (F.lit(k), v))), variant)
    aliases = own.select("session_id", F.col("alias").alias("key"), original.alias("original"), "type", F.col("_base").alias("base_id"), variant.alias("variant"), F.lit(False).alias("anchor"))
    raised = joined(codes.filter(~F.col("anchor")), own.select("session_id", F.col("primary").alias("key")).distinct(), KEY, "left_semi")
    middle = fn.person(F.col("original"))["middle"]
    raised = raised.withColumns({"variant": F.when(middle.isNotNull(), "FULL").otherwise("FIRST_LAST"), "anchor": F.lit(True)})
    changes = aliases.unionByName(raised.select(*aliases.columns)).withColumn("code", c.with_variant(F.col("base_id"), F.col("variant")))
    return upserted(codes, changes)


def renamed_persons(codes: DataFrame, names: DataFrame) -> DataFrame:
    """Codes after new names (session_id, base_id, name): the base gets a row for each variant that the name has, keyed by its text; rows it had under other keys go."""
    p = fn.person(F.col("name"))
    forms = fn.variants(p, fn.strip_title(F.col("name")))
    lone = {"MIDDLE": p["middle"].isNotNull(), "FIRST_MID": p["middle"].isNotNull(), "FULL": p["middle"].isNotNull()}
    rows = F.array(*(F.struct(F.lit(k).alias("variant"), F.when(lone.get(k, F.lit(True)), v).alias("original")) for k, v in forms.items()))
    types = codes.groupBy("session_id", "base_id").agg(F.min("type").alias("type"))
    new = joined(names, types, ("session_id", "base_id")).select("session_id", "base_id", "type", F.inline(rows)).filter(F.col("original").isNotNull())
    order = F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant"))
    new = new.withColumn("key", F.lower("original")).groupBy("session_id", "base_id", "type", "key").agg(F.min_by("variant", order).alias("variant"), F.min_by("original", order).alias("original"))
    first = Window.partitionBy("session_id", "base_id").orderBy(F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant")))
    new = new.withColumn("anchor", F.row_number().over(first) == 1).withColumn("code", c.with_variant(F.col("base_id"), F.col("variant")))
    return upserted(removed(codes, names, ("session_id", "base_id")), new)


def with_custom_terms(codes: DataFrame, docs: DataFrame, terms: DataFrame, next_: DataFrame | None = None) -> DataFrame:
    """Codes with the user's terms (session_id, term, type) that occur in a text of their session and have no code yet, trimmed. All terms are looked for in one pass over the texts."""
    own = terms.select("session_id", F.btrim("term").alias("original"), "type").withColumn("key", F.lower("original")).filter("key <> ''")
    own = own.groupBy(*KEY).agg(F.min(F.struct("original", "type")).alias("x")).select(*KEY, "x.*")
    own = joined(own, codes.select(*KEY), KEY, "left_anti")
    new = dealt(codes, joined(own, seen_terms(docs, own), KEY, "left_semi").withColumn("at", F.col("key")), next_)
    new = new.withColumns({"variant": F.lit(None).cast("string"), "anchor": F.lit(False)}).withColumn("code", c.with_variant(F.col("base_id"), F.col("variant")))
    return codes.unionByName(new.select(*codes.columns))


def without_groups(codes: DataFrame, picks: DataFrame) -> DataFrame:
    """Codes without the whole bases of the picked keys."""
    return removed(codes, joined(codes, picks, KEY, "left_semi"), ("session_id", "base_id"))


def group_states(codes: DataFrame, excluded: DataFrame) -> DataFrame:
    """(session_id, base_id, n, n_excluded, state) of each base: all, none or mixed of its keys are excluded."""
    flagged = joined(codes, excluded.select(*KEY, F.lit(1).alias("_out")), KEY, "left")
    out = flagged.groupBy("session_id", "base_id").agg(F.count(F.lit(1)).alias("n"), F.count("_out").alias("n_excluded"))
    return out.withColumn("state", F.when(F.col("n_excluded") == 0, "none").when(F.col("n_excluded") == F.col("n"), "all").otherwise("mixed"))


def toggled_groups(codes: DataFrame, excluded: DataFrame, picks: DataFrame) -> DataFrame:
    """Excluded keys after picks (session_id, base_id) of groups: one whose keys are all excluded has all included, any other has all excluded."""
    states = joined(group_states(codes, excluded), picks, ("session_id", "base_id"), "left_semi")
    keys = joined(codes.select(*KEY, "base_id"), states.select("session_id", "base_id", "state"), ("session_id", "base_id"))
    return removed(excluded.select(*KEY), keys).unionByName(keys.filter("state <> 'all'").select(*KEY))


def edited_words(words: DataFrame, changes: DataFrame) -> DataFrame:
    """The user's words (word, type) after changes (word, type, gone): words are told apart without regard to case, the last change of a word counts (`at`)."""
    last = changes.groupBy(F.lower("word").alias("_l")).agg(F.max_by(F.struct("word", "type", "gone"), "at").alias("x"))
    kept = words.withColumn("_l", F.lower("word")).join(last.select("_l"), "_l", "left_anti").select("word", "type")
    return kept.unionByName(last.filter("not x.gone").select("x.word", "x.type"))
