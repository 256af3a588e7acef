"""Entities of sessions: codes with person variants, redaction by position, restoring, checks of placeholders.

Tables: mentions (session_id, doc_id, doc_seq, row, s, e, text, type, confidence, rec_ord, pat_ord, key), codes (session_id, key, original, type, code,
base_id, variant, anchor). A null session_id is a session like any other.

Spans, placeholders and leaks belong to a document by its `row`, a key of session, id and text: ids may be null, repeat with other texts, or recur in another session.
Rows that agree in all three are copies of one document; each of them is redacted, restored and mended, and tables of spans or codes by document name them once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.functions import codes as c
from sealgrove.functions import dates
from sealgrove.functions import names as fn
from sealgrove.functions.scan import scan, splice
from sealgrove.functions.words import PREFIXES, VARIANTS
from sealgrove.operators.joins import identified, joined, numbered
from sealgrove.operators.recognizers import RULES, Rule, settled
from sealgrove.operators.spans import key_of
from sealgrove.operators.splicing import spliced
from sealgrove.sources.tables import written

PERSON_PREFIXES = tuple(v for k, v in PREFIXES.items() if k.startswith("person"))


def kept_mentions(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("session_id", "doc_id", "doc_seq"), **options) -> DataFrame:
    """Mentions without overlaps: detected and resolved in the document's row, without a shuffle."""
    read = [c for c in docs.columns if c in (*keys, "session_id", "doc_id", "text", options.get("text"))]
    found = settled(identified(docs.select(*read), "text"), rules, **options).select(*keys, "row", F.explode_outer("mentions").alias("m")).filter("m is not null")
    return found.select(*keys, "row", "m.*").withColumn("key", key_of(F.col("text"))).filter(F.length("key") > 1)


def _persons_name(text: Column) -> Column:
    """A name's words without title, in lower case."""
    return F.lower(F.array_join(fn.tokens(fn.strip_title(text)), " "))


def assign_codes(mentions: DataFrame) -> DataFrame:
    """Codes of a session's distinct keys, in the order in which they first appear in its documents.

    In each document, persons of two or more words are registered first: each is an anchor with a number of its own and the variant FULL (more
    than two words) or FIRST_LAST. A person that is a variant of an anchor of this or an earlier document (its first, last or middle name, these with a title, the full name, or a beginning of the first)
    shares the anchor's number (the anchor of the longest key, then the earliest, if there are several). All others get the next number of their type.
    """
    at = F.struct("doc_seq", "s", "rec_ord", "pat_ord")
    by = F.xxhash64("session_id", "key").alias("_by")  # texts are aggregated in sorted order; a number sorts by itself, a session is shared by most rows
    first = mentions.groupBy(by, "session_id", "key").agg(F.min(at).alias("at"), F.min_by("text", at).alias("original"), F.min_by("type", at).alias("type")).drop("_by")
    person = F.col("type").startswith("person")
    full = F.when(person & (F.size(fn.tokens(fn.strip_title(F.col("original")))) >= 2), _persons_name(F.col("original")))
    first = first.withColumn("full", full).withColumn("bare", F.when(person, F.lower(fn.strip_title(F.col("original")))))
    nth = F.row_number().over(Window.partitionBy("session_id", "full").orderBy("at", "key"))
    anchors = first.filter("full is not null").withColumn("_nth", nth).filter("_nth = 1").drop("_nth")  # the rows of one name of a session
    first = written(joined(first, anchors.select("session_id", "key", F.lit(True).alias("anchor")), ("session_id", "key"), "left").withColumn("anchor", F.coalesce("anchor", F.lit(False))), "keys")

    # Names and anchors meet by forms: what a name is, a beginning of an anchor's first name, or an anchor's first name that a name begins with.
    p, whole = fn.person(F.col("original")), fn.strip_title(F.col("original"))
    begins = lambda x, least: F.when(F.length(x) >= least, F.transform(F.sequence(F.lit(least), F.length(x)), lambda k: F.substring(x, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    tagged = lambda xs, tag: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    forms = F.filter(F.array(*(F.lower(x) for x in fn.variants(p, whole).values())), lambda x: x.isNotNull())
    anchored = tagged(F.concat(forms, begins(F.lower(p["first"]), 3)), "=")
    anchored = F.array_distinct(F.concat(anchored, F.array(F.concat(F.lit("<"), F.lower(p["first"])))))
    parents = first.filter("anchor").select("session_id", F.explode(anchored).alias("form"), F.col("key").alias("parent"), F.col("at").alias("_at"), F.col("original").alias("_name"))
    asked = F.concat(F.array(F.concat(F.lit("="), "bare")), F.when(F.length("bare") >= 3, tagged(begins(F.col("bare"), 1), "<")).otherwise(F.array().cast("array<string>")))
    met = joined(first.filter(~F.col("anchor") & F.col("bare").isNotNull()).withColumn("form", F.explode(asked)), parents, ("session_id", "form"))
    part = fn.variant_for(F.col("original"), fn.person(F.col("_name")), fn.strip_title(F.col("_name")))
    met = met.filter(part.isNotNull() & (F.col("_at.doc_seq") <= F.col("at.doc_seq")))
    best = F.struct((-F.length("parent")).alias("l"), "_at", "parent", "_name")
    children = met.groupBy("session_id", "key", "original", "type").agg(F.min(best).alias("b")).select("session_id", "key", "original", "type", "b.parent", F.col("b._name").alias("_name"))

    own = joined(first, children.select("session_id", "key"), ("session_id", "key"), "left_anti")
    own = own.select("session_id", "key", "original", "type", "anchor", "at.*", (~F.col("anchor")).alias("later"))
    own = numbered(own, ("session_id", "type"), ("doc_seq", "later", "s", "rec_ord", "pat_ord", "key"))
    words = F.size(fn.tokens(fn.strip_title(F.col("original"))))
    variant = F.when(F.col("anchor"), F.when(words > 2, "FULL").otherwise("FIRST_LAST"))
    own = own.withColumn("base_id", c.base_id(F.col("type"), F.col("n"))).withColumn("variant", variant)
    own = own.select("session_id", "key", "original", "type", "base_id", "variant", "anchor")
    up = own.filter("anchor").select("session_id", F.col("key").alias("parent"), "base_id", F.col("variant").alias("_variant"))
    children = joined(children, up, ("session_id", "parent")).withColumn("variant", F.coalesce(part, "_variant")).withColumn("anchor", F.lit(False))
    out = own.unionByName(children.select(*own.columns))
    return out.select("session_id", "key", "original", "type", c.with_variant(F.col("base_id"), F.col("variant")).alias("code"), "base_id", "variant", "anchor")


def persons(codes: DataFrame) -> DataFrame:
    """(session_id, base_id, full, title, first, last, middle) of the anchors."""
    name = F.col("original")
    return codes.filter("anchor").select("session_id", "base_id", fn.strip_title(name).alias("full"), *(x.alias(k) for k, x in fn.person(name).items()))


def mapping(codes: DataFrame) -> DataFrame:
    """(session_id, code, original), one row a code: what each placeholder of a session stands for.

    An anchor gives its base the first name and each variant its form of the name. A person without anchor gives all variants the one name. Others are as
    they are stored.
    """
    p = persons(codes)
    forms = fn.variants({k: F.col(k) for k in ("title", "first", "last", "middle")}, F.col("full"))
    rows = [F.struct(F.lit(None).cast("string").alias("variant"), F.col("first").alias("original")), *(F.struct(F.lit(v).alias("variant"), x.alias("original")) for v, x in forms.items())]
    named = p.select("session_id", "base_id", F.inline(F.array(*rows))).filter("original <> ''")
    named = named.select("session_id", c.with_variant(F.col("base_id"), F.col("variant")).alias("code"), "original")
    rest = joined(codes, p.select("session_id", "base_id"), ("session_id", "base_id"), "left_anti")
    single = F.col("variant").isNull() & F.regexp_extract("base_id", "^[A-Z]+", 0).isin(*PERSON_PREFIXES)
    variants = F.array(F.lit(None).cast("string"), *map(F.lit, VARIANTS))
    rest = rest.withColumn("_v", F.explode(F.when(single, variants).otherwise(F.array("variant"))))
    code = F.when(single, c.with_variant(F.col("base_id"), F.col("_v"))).otherwise(F.col("code"))
    stored = rest.groupBy("session_id", code.alias("code")).agg(F.min_by("original", F.struct(F.col("_v").isNotNull(), "key")).alias("original"))
    return named.unionByName(stored)


def coded(mentions: DataFrame, codes: DataFrame, keep_year: bool = True) -> DataFrame:
    """Mentions with what stands for them: `code`, and `shown` with a date's year."""
    out = joined(mentions.drop("type"), codes.select("session_id", "key", "type", "code", "original"), ("session_id", "key"))
    return out.withColumn("shown", c.rendered(F.col("code"), F.col("type"), F.col("text"), keep_year))


def _gathered(spans: DataFrame, shown: str) -> Column:
    """A document's spans in order, each once."""
    return F.array_sort(F.collect_set(F.struct("s", "e", F.col(shown).alias("code")))).alias("_spans")


def redact(docs: DataFrame, coded: DataFrame) -> DataFrame:
    """`docs` with `redacted`: each coded mention replaced, by position."""
    return spliced(identified(docs, "text"), coded, "text", "redacted", "shown")


def output_offsets(coded: DataFrame) -> DataFrame:
    """Where replacements stand in the redacted text."""
    before = Window.partitionBy("row").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("shown") - (F.col("e") - F.col("s"))).over(before), F.lit(0))
    return coded.dropDuplicates(["row", "s"]).select("doc_id", "shown", (F.col("s") + shift).cast("int").alias("out_s"), (F.col("s") + shift + F.length("shown")).cast("int").alias("out_e"))


def placeholders(docs: DataFrame, text: str = "redacted", keys: tuple[str, ...] = ("session_id", "doc_id")) -> DataFrame:
    """Placeholders of a text with their places and the `row` of the document with this text; a date's takes the year behind it."""
    found = identified(docs, text).select(*keys, "row", F.explode(scan(F.col(text), c.PLACEHOLDER)).alias("p")).select(*keys, "row", "p.*")
    return found.withColumn("code", F.regexp_extract("t", r"\[[^\]]+\]", 0))


def with_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """A mapping with the user's texts in place of the originals, those for codes that aren't in it included; the greatest of several for a code counts."""
    own = overrides.groupBy("session_id", "code").agg(F.max("text").alias("_own"))
    both = joined(rows, own, ("session_id", "code"), "left").withColumn("original", F.coalesce("_own", "original")).drop("_own")
    return both.unionByName(joined(own, rows.select("session_id", "code"), ("session_id", "code"), "left_anti").withColumnRenamed("_own", "original"))


def restore(docs: DataFrame, rows: DataFrame, overrides: DataFrame | None = None, text: str = "redacted", normal_dates: bool = False) -> DataFrame:
    """`docs` with `restored`: placeholders replaced by what their session's mapping has for them; those unknown or without a text stay.

    An override goes before the original. Dates of the restored text are written as dd/MM/yyyy if `normal_dates`.
    """
    if overrides is not None:
        rows = with_overrides(rows, overrides)
    found = joined(placeholders(docs, text), rows.filter(F.col("original") != ""), ("session_id", "code"))
    out = spliced(identified(docs, text), found, text, "restored", "original")
    return dates.with_normal_dates(out, "restored", "restored") if normal_dates else out


def unknown_placeholders(docs: DataFrame, codes: DataFrame, text: str) -> DataFrame:
    """Placeholders of a text that its session has no code for."""
    found = docs.select("session_id", "doc_id", F.explode(c.codes_in(F.col(text))).alias("code"))
    return joined(found, codes.select("session_id", "code"), ("session_id", "code"), "left_anti").distinct()  # few are left


def missing_placeholders(coded: DataFrame, docs: DataFrame, text: str, source: str = "text") -> DataFrame:
    """(session_id, doc_id, code): codes of a document, whose own text is `source`, that a text of it no longer has."""
    texts = identified(docs, source).select("session_id", "doc_id", "row", F.coalesce(c.codes_in(F.col(text)), F.array().cast("array<string>")).alias("_left"))
    own = coded.groupBy("row").agg(F.collect_set("code").alias("_codes"))
    return texts.join(own.hint("merge"), "row").select("session_id", "doc_id", F.explode(F.array_except("_codes", "_left")).alias("code"))


def fix_partial_leaks(docs: DataFrame, codes: DataFrame, text: str, source: str = "text") -> DataFrame:
    """`docs` with `fixed`: letters that follow a code go, where the original with them occurs in the source."""
    docs = identified(docs, text, source)
    leaks = docs.select("session_id", "row", F.explode(scan(F.col(text), r"\[[A-Z_]+\][a-zA-Z]+")).alias("p")).select("session_id", "row", "p.*")
    leaks = leaks.withColumn("code", F.regexp_extract("t", r"^\[[A-Z_]+\]", 0)).withColumn("_tail", F.regexp_extract("t", r"\]([a-zA-Z]+)$", 1))
    known = joined(leaks, codes.groupBy("session_id", "code").agg(F.collect_set(F.lower("original")).alias("_names")), ("session_id", "code"))
    own = known.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", "e", "code", "_names", "_tail"))).alias("_leaks"))
    out = docs.join(own.hint("merge"), "row", "left").drop("row")
    low = F.lower(F.col(source))
    real = F.filter("_leaks", lambda x: F.exists(x["_names"], lambda n: F.contains(low, F.concat(n, F.lower(x["_tail"])))))
    spans = F.transform(real, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["code"].alias("code")))
    out = out.withColumn("_spans", spans)
    return out.withColumn("fixed", F.when(F.col("_spans").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_spans")))).drop("_leaks", "_spans")


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_year: bool = True, find: Callable[..., DataFrame] = kept_mentions, counted: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Redacted documents (session_id, doc_id, doc_seq, text, redacted, n_entities) and their sessions' codes: detect, resolve, number, replace. `find`: what gives the mentions.

    Texts are searched once; mentions and codes are written, which are small beside the texts. Unless `counted`, there is no n_entities, and no array of spans of a document.
    """
    mentions = written(find(docs, rules, **options), "mentions")
    codes = written(assign_codes(mentions), "codes")
    own = coded(mentions, codes, keep_year)
    if not counted:
        return redact(docs, own), codes
    spans = own.groupBy("row").agg(_gathered(own, "shown"), F.size(F.collect_set("key")).alias("n_entities"))
    out = identified(docs, "text").join(spans.hint("merge"), "row", "left").drop("row").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    out = out.withColumn("redacted", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("_spans"))))
    return out.drop("_spans"), codes
