"""Second pass over texts: findings against what is known, merging of lists, parts of names, leaks, and steps that follow a name model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.functions import words as w
from sealgrove.functions.names import person, tokens
from sealgrove.functions.scan import scan
from sealgrove.operators.joins import joined
from sealgrove.operators.names import EXCLUDED

# What a name model's tags stand for.
TAGS = {"personalName": "person_other", "placeName": "location", "organizationName": "organization"}
# Which type wins where a text has several.
PRIORITY = {"identifier": 3, "contact": 3, "date": 3, "person_client": 2, "person_provider": 2, "person_other": 2}
# Parts of a person that are looked for, with their confidences and least lengths.
PART_RULES = (("FIRST", "first", 0.9, 3), ("LAST", "last", 0.9, 3), ("MIDDLE", "middle", 0.9, 2))
FORMAL_CONFIDENCE = 0.95


def new_findings(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """Findings (doc_id, text) of a document whose text is no entity's, nor part of one, nor has one as a part, without regard to case."""
    known = entities.select(F.col("doc_id").alias("_doc"), F.lower("text").alias("_known")).distinct()
    low = F.lower("text")
    return findings.join(known.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.contains(F.col("_known"), low) | F.contains(low, F.col("_known"))), "left_anti")


def not_known(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """Findings of a document whose text, in lower case, is no entity's; repeated ones stay."""
    known = entities.select("doc_id", F.lower("text").alias("_l")).distinct()
    return joined(findings.withColumn("_l", F.lower("text")), known, ("doc_id", "_l"), "left_anti", large=True).drop("_l")


def all_entities(detected: DataFrame, removed: DataFrame, **others: DataFrame) -> DataFrame:
    """Detected entities (doc_id, text, type) but for removed ones, and those of other lists, each with its `source`."""
    out = joined(detected, removed.select("doc_id", "text").distinct(), ("doc_id", "text"), "left_anti").withColumn("source", F.lit("detected"))
    for name, df in others.items():
        out = out.unionByName(df.select("doc_id", "text", "type", F.lit(name).alias("source")))
    return out


def best_types(entities: DataFrame) -> DataFrame:
    """One type for each text of a document: that of the highest priority, then of the highest confidence, then the first by name."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("type")), F.lit(1))
    best = F.struct((-rank).alias("r"), (-F.col("confidence")).alias("c"), "type")
    return entities.groupBy("doc_id", F.lower("text").alias("key")).agg(F.min(best).alias("b")).select("doc_id", "key", "b.type", (F.lit(0.0) - F.col("b.c")).alias("confidence"))


def model_and_patterns(model: DataFrame, patterns: DataFrame) -> DataFrame:
    """A row for each text of a document: the model's, unless a pattern is strictly surer; a model's unknown confidence counts as 0."""
    both = model.select("doc_id", "text", "type", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(0).alias("o"))
    both = both.unionByName(patterns.select("doc_id", "text", "type", "confidence", F.lit(1).alias("o")))
    best = F.struct((-F.col("confidence")).alias("c"), "o", "type", "text")
    out = both.groupBy("doc_id", F.lower("text").alias("key")).agg(F.min(best).alias("b"))
    return out.select("doc_id", "key", "b.text", "b.type", (F.lit(0.0) - F.col("b.c")).alias("confidence"), (F.col("b.o") == 0).alias("from_model"))


def name_parts(persons: DataFrame) -> DataFrame:
    """(..., part, text, confidence): the parts by which persons (`name` of two words or more) are looked for in the texts."""
    p = person(F.col("name"))
    rows = [F.struct(F.lit(k).alias("part"), F.when(F.length(p[x]) >= n, p[x]).alias("text"), F.lit(conf).alias("confidence")) for k, x, conf, n in PART_RULES]
    rows.append(F.struct(F.lit("FORMAL").alias("part"), F.when(F.length(p["last"]) >= 3, F.concat_ws(" ", F.coalesce(p["title"], F.lit("Mr")), p["last"])).alias("text"), F.lit(FORMAL_CONFIDENCE).alias("confidence")))
    two = persons.filter(F.size(tokens(F.col("name"))) >= 2)
    return two.select("*", F.inline(F.array(*rows))).filter(F.col("text").isNotNull())


def occurrences_of_terms(docs: DataFrame, terms: DataFrame, possessive: bool = True, large: bool = False) -> DataFrame:
    """(doc_id, term, s, e, text): where a session's terms (session_id, term) occur in its texts as words, in any case, an s behind them included.

    Texts are cut into words once and terms are met by their first word; the rest of a term is compared in place. `large`: terms grow with the documents, so that they are not broadcast.
    """
    first = F.lower(F.regexp_extract("term", r"^[\p{L}\p{N}_]+", 0))
    own = terms.select("session_id", "term", first.alias("_first")).filter("_first <> ''").distinct()
    found = docs.select("session_id", "doc_id", F.length("text").alias("_n"), F.explode(scan(F.col("text"), r"[\p{L}\p{N}_]+")).alias("m"), "text")
    words = found.select("session_id", "doc_id", "m.s", F.lower("m.t").alias("_word"))
    # A word is a term's first, or that with an s if the term has no other.
    tries = words.select("session_id", "doc_id", "s", F.explode(F.array_distinct(F.array("_word", F.regexp_replace("_word", "s$", "") if possessive else F.col("_word")))).alias("_first"))
    met = joined(tries, own, ("session_id", "_first"), large=large).groupBy("doc_id").agg(F.collect_set(F.struct("s", "term")).alias("_tries"))
    both = joined(docs.select("doc_id", "text"), met, ("doc_id",), large=True).withColumn("_low", F.lower("text"))
    at = lambda x: F.substring(F.col("_low"), x["s"] + 1, F.length(x["term"]))
    tail = lambda x: F.substring(F.col("_low"), x["s"] + 1 + F.length(x["term"]), F.lit(2))
    word, word_s = "^[\\p{L}\\p{N}_]", "^s(?![\\p{L}\\p{N}_])"
    extra = lambda x: F.when(tail(x).rlike(word_s), 1).otherwise(0) if possessive else F.lit(0)
    good = F.filter("_tries", lambda x: (at(x) == F.lower(x["term"])) & (~tail(x).rlike(word) | (extra(x) == 1)))
    spans = F.transform(good, lambda x: F.struct(x["term"].alias("term"), x["s"].alias("s"), (x["s"] + F.length(x["term"]) + extra(x)).alias("e"), F.substring(F.col("text"), x["s"] + 1, F.length(x["term"]) + extra(x)).alias("text")))
    return both.select("doc_id", F.explode(spans).alias("x")).select("doc_id", "x.*")


def leaked_names(findings: DataFrame, codes: DataFrame) -> DataFrame:
    """(session_id, doc_id, code, old, text): findings that contain a code and letters behind it; the entity becomes its original with those letters."""
    part = F.regexp_extract("text", r"(\[[A-Z_]+\])[A-Za-z]+", 1)
    own = findings.withColumn("code", part).filter("code <> ''").withColumn("_tail", F.regexp_extract("text", r"\[[A-Z_]+\]([A-Za-z]+)", 1)).drop("text")
    known = codes.groupBy("session_id", "code").agg(F.min("original").alias("old"))
    return joined(own, known, ("session_id", "code")).select("session_id", "doc_id", "code", "old", F.concat("old", "_tail").alias("text"))


def session_statistics(codes: DataFrame) -> DataFrame:
    """Codes of each session by type, and how many there are of all types together."""
    out = codes.groupBy("session_id").pivot("type", sorted(set(TAGS.values()) | {"date", "contact", "identifier"})).agg(F.count(F.lit(1)))
    total = codes.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return joined(out.na.fill(0), total, ("session_id",))


def plausible_names(mentions: DataFrame) -> DataFrame:
    """Mentions but for those of three words or more with a small inner word that is no particle of names."""
    words = F.split("text", " +")
    inner = F.when(F.size(words) >= 3, F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return mentions.filter(~F.exists(inner, lambda x: x.rlike("^[a-z]") & ~x.isin(*w.PARTICLES)))


def _behind(text: Column, mentions: Column) -> Column:
    """Mentions of one word, as far as the capitalised word behind them that is neither common nor excluded; others as they are."""
    word = lambda m: F.regexp_extract(F.substring(text, m["e"] + 1, F.lit(60)), "^ +([A-Z][a-z]+)(?![\\p{L}\\p{N}_])", 0)
    name = lambda m: F.regexp_extract(F.substring(text, m["e"] + 1, F.lit(60)), "^ +([A-Z][a-z]+)(?![\\p{L}\\p{N}_])", 1)
    more = lambda m: (~F.contains(m["text"], F.lit(" "))) & (word(m) != "") & ~F.lower(name(m)).isin(*EXCLUDED)
    return F.transform(mentions, lambda m: F.struct(m["s"].alias("s"), F.when(more(m), m["e"] + F.length(word(m))).otherwise(m["e"]).alias("e"), F.when(more(m), F.concat(m["text"], word(m))).otherwise(m["text"]).alias("text")))


def _before(text: Column, mentions: Column) -> Column:
    """Mentions with the capitalised name word that stands one blank before them, unless it begins its sentence or line."""
    lead = "([^\\p{L}.\\n•\\-:;])([A-Z]\\p{L}*) $"
    back = lambda m: F.substring(text, F.greatest(m["s"] - 39, F.lit(1)), F.least(m["s"], F.lit(40)))
    name = lambda m: F.regexp_extract(back(m), lead, 2)
    more = lambda m: (name(m) != "") & F.lower(name(m)).isin(*w.NAME_WORDS)
    return F.transform(mentions, lambda m: F.struct(F.when(more(m), m["s"] - F.length(name(m)) - 1).otherwise(m["s"]).alias("s"), m["e"].alias("e"), F.when(more(m), F.concat(name(m), F.lit(" "), m["text"])).otherwise(m["text"]).alias("text")))


def extended_names(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Persons' mentions (doc_id, s, e, text) as far as the surname behind single names and with the name word before them; a text is read once for all of its mentions."""
    own = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "text"))).alias("_m"))
    both = joined(docs.select("doc_id", F.col("text").alias("_text")), own, ("doc_id",), large=True)
    return both.select("doc_id", F.inline(_before(F.col("_text"), _behind(F.col("_text"), F.col("_m")))))


def parents_of(names: DataFrame) -> DataFrame:
    """(session_id, name, parent): of single names the first full name (by `at`) of the session that begins or ends with it as a word."""
    low = names.select("session_id", "name", "at", F.lower("name").alias("_l")).withColumn("_t", tokens(F.col("_l")))
    full = low.filter(F.size("_t") >= 2).select("session_id", F.col("name").alias("parent"), F.col("at").alias("_at"), F.explode(F.array_distinct(F.array(F.get("_t", F.lit(0)), F.element_at("_t", F.lit(-1))))).alias("_l"))
    met = joined(low.filter(F.size("_t") == 1).select("session_id", "name", "_l"), full, ("session_id", "_l"))
    return met.groupBy("session_id", "name").agg(F.min_by("parent", F.struct("_at", "parent")).alias("parent"))


def first_of_each(rows: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
