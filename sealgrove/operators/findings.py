"""What a model or a second pass finds, made into entities: tags become types, names get surnames and parts, findings get places, and through the codes of their session numbers.

Edge cases: tags that stand for no type are dropped, a tag's missing confidence counts as 0; null texts have no findings; findings that stand nowhere in their text are dropped; repeated ones are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealgrove.functions.names import person
from sealgrove.functions.scan import MENTIONS, let, scan
from sealgrove.operators.joins import joined
from sealgrove.operators.names import EXCLUDED
from sealgrove.operators.review import TAGS, name_parts
from sealgrove.operators.spans import key_of
from sealgrove.operators.whole import NAMES, _any, _first_of_key, _words

#: Where a model and what follows it come among the recognizers.
MODEL, FINDING = 16, 30
#: What words are made of.
WORD = r"[\p{L}\p{N}_]"
FIRSTS = "array<struct<key:string,s:int,e:int,text:string,type:string,confidence:double,rec_ord:int,pat_ord:int>>"


def tagged_mentions(tags: Column) -> Column:
    """MENTIONS of a model's tags, structs of s, e, text, tag and confidence."""
    types = F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv))
    known = F.filter(tags, lambda t: t["tag"].isin(*TAGS) & (t["s"] < t["e"]))
    out = F.transform(known, lambda t: F.struct(
        t["s"].cast("int").alias("s"), t["e"].cast("int").alias("e"), t["text"].alias("text"), types[t["tag"]].alias("type"),
        F.coalesce(t["confidence"], F.lit(0.0)).cast("double").alias("confidence"), F.lit(MODEL).alias("rec_ord"), F.lit(0).alias("pat_ord")))
    return F.coalesce(out, F.array().cast(MENTIONS))


def surnames(text: Column, names: Column) -> Column:
    """A map of those single names that a surname follows anywhere in the text: the first capitalised word behind blanks that is neither a common nor a clinical word."""
    single = F.array_distinct(F.filter(names, lambda n: ~F.contains(n, F.lit(" ")) & (n != "")))

    def found(own: Column) -> Column:
        pattern = F.concat(F.lit(r"\b("), _any(own), F.lit(r")(?= +([A-Z][a-z]+)\b)"))
        pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("b"))
        usable = F.filter(F.transform(pairs, lambda p, i: F.struct(p["a"].alias("a"), p["b"].alias("b"), i.alias("i"))), lambda p: ~F.lower(p["b"]).isin(*EXCLUDED))
        rows = F.transform(usable, lambda p: F.struct(p["a"].alias("key"), p["i"].cast("int").alias("s"), p["b"].alias("name"), F.lit("").alias("type"), F.lit(0.0).alias("confidence")))
        return F.map_from_entries(F.transform(_first_of_key(rows, NAMES), lambda x: F.struct(x["key"], x["name"])))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.when(F.size(single) > 0, let(single, found)), none)


def first_names(text: Column, mentions: Column) -> Column:
    """Further mentions: the first names of persons of two words or more among `mentions`, where they stand alone, in any case and with an s behind.

    A first name has three letters or more, is no common word and no mention's text. Of several persons with a first name the first counts; its own place is no further one.
    One search of the text finds all first names; of two at one place the longer one counts.
    """
    texts = F.transform(mentions, lambda m: F.lower(m["text"]))
    whole = F.filter(mentions, lambda m: m["type"].startswith("person") & (F.size(_words(m["text"])) >= 2))
    named = F.transform(whole, lambda m: let(F.element_at(_words(m["text"]), 1), lambda x: F.struct(
        F.lower(x).alias("key"), m["s"].alias("s"), m["e"].alias("e"), x.alias("text"), m["type"].alias("type"), m["confidence"].alias("confidence"), m["rec_ord"].alias("rec_ord"), m["pat_ord"].alias("pat_ord"))))
    usable = lambda ts: F.filter(_first_of_key(named, FIRSTS), lambda x: (F.length(x["key"]) >= 3) & ~x["key"].isin(*EXCLUDED) & ~F.array_contains(ts, x["key"]))

    def found(own: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)\b(?:"), _any(F.transform(own, lambda x: x["text"])), F.lit(r")s?\b"))

        def mention(m: Column, x: Column) -> Column:
            low = F.lower(x["t"])
            by = F.coalesce(F.element_at(m, low), F.element_at(m, F.regexp_replace(low, "s$", "")))
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), by.alias("by"))

        hits = let(F.map_from_entries(F.transform(own, lambda x: F.struct(x["key"], x))), lambda m: F.transform(scan(text, pattern), lambda x: mention(m, x)))
        apart = F.filter(hits, lambda h: h["by"].isNotNull() & ~((h["s"] >= h["by"]["s"]) & (h["e"] <= h["by"]["e"])))
        return F.transform(apart, lambda h: F.struct(h["s"], h["e"], *(h["by"][f].alias(f) for f in ("text", "type", "confidence", "rec_ord", "pat_ord"))))

    none = F.array().cast(MENTIONS)
    return F.coalesce(let(texts, lambda ts: let(usable(ts), lambda own: F.when(F.size(own) > 0, found(own).cast(MENTIONS)).otherwise(none))), none)


def second_pass(**findings: DataFrame) -> DataFrame:
    """(session_id, text, reason): what several searches found, each under its name; a text that several found has a row for each."""
    rows = (df.select("session_id", "text", F.lit(name).alias("reason")).distinct() for name, df in findings.items())
    return reduce(DataFrame.unionByName, rows)


def terms_in(text: Column, terms: Column) -> Column:
    """Where terms (structs of key, text, type, confidence, pat_ord and `first`, their first word in lower case) occur in a text as words, in any case, an s behind them included: the same places as review.occurrences_of_terms."""

    def places(low: Column, m: Column) -> Column:
        tail = lambda t: F.substring(low, m["s"] + 1 + F.length(t["text"]), F.lit(2))
        owned = lambda t: tail(t).rlike(rf"^s(?!{WORD})")
        here = lambda t: (F.substring(low, m["s"] + 1, F.length(t["text"])) == F.lower(t["text"])) & (~tail(t).rlike(f"^{WORD}") | owned(t))
        word = F.struct(F.lower(m["t"]).alias("w"), F.regexp_replace(F.lower(m["t"]), "s$", "").alias("v"))
        met = let(word, lambda x: F.filter(terms, lambda t: ((t["first"] == x["w"]) | (t["first"] == x["v"])) & here(t)))
        end = lambda t: m["s"] + F.length(t["text"]) + F.when(owned(t), 1).otherwise(0)
        return F.transform(met, lambda t: F.struct(m["s"].alias("s"), end(t).alias("e"), *(t[f].alias(f) for f in ("key", "text", "type", "confidence", "pat_ord"))))

    return let(F.lower(text), lambda low: F.flatten(F.transform(scan(text, f"{WORD}+"), lambda m: places(low, m))))


def found_mentions(docs: DataFrame, mentions: DataFrame, findings: DataFrame) -> DataFrame:
    """Mentions that findings (row, text, type, confidence) add to those of their documents: all places of each finding that is no entity yet, and of the parts of persons among them.

    Parts are first, last (unless it is the first) and middle names, and a title with the last name; one that is an entity or a finding already is left out. `docs` and `mentions` have `row`, the
    columns session_id and doc_seq, counted from 0. The new mentions come behind all of their session, so that codes dealt over both (entities.assign_codes) leave those dealt before as they are.
    """
    known = mentions.select("row", "key").distinct().hint("merge")  # no key is null: what is grouped by document and key stays where it is dealt
    first = findings.withColumn("key", key_of(F.col("text"))).filter(F.length("key") > 1).groupBy("row", "key").agg(F.min(F.struct("text", "type", "confidence")).alias("x"))
    new = first.select("row", "key", F.btrim("x.text").alias("text"), "x.type", "x.confidence").join(known, ["row", "key"], "left_anti").withColumn("pat_ord", F.lit(0))
    names = new.filter(F.col("type").startswith("person")).withColumnsRenamed({"text": "name", "confidence": "_sure", "key": "_whole"}).drop("pat_ord")
    p = person(F.col("name"))
    usable = F.when(F.col("part") == "FORMAL", p["title"].isNotNull()).when(F.col("part") == "LAST", F.lower(p["last"]) != F.lower(p["first"])).otherwise(F.lit(True))
    parts = name_parts(names).filter(usable).withColumn("key", key_of(F.col("text")))
    parts = parts.groupBy("row", "key").agg(F.min(F.struct("text", "type", "confidence")).alias("x")).select("row", "key", "x.*", F.lit(1).alias("pat_ord"))
    parts = parts.join(known, ["row", "key"], "left_anti").join(new.select("row", "key").hint("merge"), ["row", "key"], "left_anti")
    terms = new.unionByName(parts)

    own = docs.select("row", "session_id", "doc_id", "doc_seq", "text").dropDuplicates(["row"])
    # A document's terms come to its text, which is dealt once; its words are met in the row and make no rows of their own.
    first = F.lower(F.regexp_extract("text", rf"^{WORD}+", 0))
    listed = terms.withColumn("first", first).filter("first <> ''").groupBy("row").agg(F.collect_list(F.struct("key", "text", "type", "confidence", "pat_ord", "first")).alias("_terms"))
    both = own.join(listed.hint("merge"), "row")
    last = mentions.groupBy("session_id").agg(F.max("doc_seq").alias("_last"))
    both = joined(both.select("row", "session_id", "doc_id", "doc_seq", F.explode(terms_in(F.col("text"), F.col("_terms"))).alias("x")), last, ("session_id",), "left")
    out = both.withColumn("doc_seq", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("doc_seq")).withColumn("rec_ord", F.lit(FINDING)).select("*", "x.*")
    return out.select("session_id", "doc_id", "doc_seq", "row", "s", "e", "text", "type", "confidence", "rec_ord", "pat_ord", "key")
