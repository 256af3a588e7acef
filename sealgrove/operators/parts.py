"""Parts of documents, replacement by text, lists in and out, and what an answer refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealgrove.functions import codes as c
from sealgrove.functions.scan import scan, splice
from sealgrove.functions.words import PREFIXES
from sealgrove.operators.joins import identified, joined

BOUNDARIES = "struct<documents:array<struct<title:string,author:string,date:string,type:string,startLine:int,endLine:int,summary:string>>>"
#: Windows of a long text are so many characters at about a hundred a line, and overlap by so many.
WINDOW, WINDOW_OVERLAP, LINE = 250_000, 20_000, 100


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sub_documents(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, id, title, author, date, type, summary, content): documents within documents, as a model's answers (doc_id, json) bound them by lines.

    Lines count from 1; the last sub-document goes on to the end. Where lines are impossible, the text is cut into as many pieces of equal length.
    A single one is the whole text, and so is an answer that can't be read.
    """
    parsed = F.from_json(F.regexp_extract("json", r"(?s)\{.*\}", 0), BOUNDARIES)["documents"]
    both = joined(docs.select("doc_id", "text"), answers.select("doc_id", parsed.alias("_d")), ("doc_id",))
    none = F.from_json(F.lit('{"documents": [{"title": "Document", "type": "Unknown", "summary": ""}]}'), BOUNDARIES)["documents"]
    both = both.withColumns({"_d": F.coalesce("_d", none), "_lines": F.split("text", "\n"), "_n": F.size(F.coalesce("_d", none))})
    each = both.select("doc_id", "text", "_lines", "_n", F.posexplode("_d").alias("_i", "_x"))
    size, start = F.size("_lines"), F.greatest(F.lit(0), F.coalesce("_x.startLine", F.lit(1)) - 1)
    end = F.when(F.col("_i") == F.col("_n") - 1, size - 1).otherwise(F.least(F.coalesce("_x.endLine", size) - 1, size - 1))
    lines = F.array_join(F.slice("_lines", start + 1, F.greatest(end - start + 1, F.lit(0))), "\n")
    length = F.floor(F.length("text") / F.col("_n")).cast("int")
    piece = F.substring("text", F.col("_i") * length + 1, length)
    content = F.when(F.col("_n") == 1, F.col("text")).otherwise(_trimmed(F.when((start <= end) & (start < size), lines).otherwise(piece)))
    title = F.coalesce("_x.title", F.when(F.col("_n") == 1, "Document").otherwise(F.concat(F.lit("Document "), F.col("_i") + 1)))
    name = F.when(F.col("_n") == 1, "doc1").otherwise(F.concat(F.lit("doc_"), F.col("_i")))
    return each.select("doc_id", name.alias("id"), title.alias("title"), "_x.author", "_x.date", F.coalesce("_x.type", F.lit("Unknown")).alias("type"), F.coalesce("_x.summary", F.lit("")).alias("summary"), content.alias("content"))


def boundary_windows(docs: DataFrame, window: int = WINDOW, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """(doc_id, window_no, first_line, last_line): overlapping windows of lines, the last of which ends with the text."""
    rows, shared = max(1, window // LINE), min(overlap // LINE, max(0, window // LINE - 1))
    n = F.size(F.split("text", "\n"))
    last = F.greatest(F.lit(0), F.ceil((n - rows) / (rows - shared))).cast("int")
    out = docs.select("doc_id", n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    first = F.col("window_no") * (rows - shared) + 1
    return out.select("doc_id", "window_no", first.alias("first_line"), F.least("_n", first + rows - 1).alias("last_line"))


def distinct_sub_documents(found: DataFrame) -> DataFrame:
    """Sub-documents (doc_id, window_no, first_line, title, author) that several windows found, once: by their first line, or by title and author where it isn't known."""
    name = F.when(F.col("first_line").isNull(), F.struct("title", "author"))
    once = found.groupBy("doc_id", "first_line", name.alias("_name")).agg(F.min(F.struct("window_no", "title", "author")).alias("x"))
    return once.select("doc_id", "first_line", "x.title", "x.author")


def chunk_positions(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans (doc_id, chunk_no, s, e, text) of chunks as spans of their documents; those wholly in an overlap are their neighbour's."""
    place = chunks.select("doc_id", "chunk_no", "global_offset", "overlap_before", (F.length("text") - F.col("overlap_after")).alias("_stop"))
    own = joined(spans, place, ("doc_id", "chunk_no")).filter((F.col("e") > F.col("overlap_before")) & (F.col("s") < F.col("_stop")))
    return own.select("doc_id", (F.col("s") + F.col("global_offset")).alias("s"), (F.col("e") + F.col("global_offset")).alias("e"), "text").distinct()


def redact_by_text(docs: DataFrame, entities: DataFrame, keep_year: bool = True) -> DataFrame:
    """`docs` with `redacted`: every occurrence of the texts of a document's entities (doc_id, text, type, code), in any case, the longest first.

    Persons take a possessive 's or s behind them along. An occurrence begins and ends at a word's edge, a blank or the text's end. Of entities of
    equal text the greatest code counts.
    """
    quoted = F.concat(F.lit("\\Q"), F.replace("text", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    quoted = F.concat(quoted, F.when(F.col("type").startswith("person"), "(?:'s|s(?![a-zA-Z]))?").otherwise(""))
    shown = c.rendered(F.col("code"), F.col("type"), F.col("text"), keep_year)
    rows = entities.filter("text <> ''").select("doc_id", (-F.length("text")).alias("l"), F.col("text").alias("t"), quoted.alias("q"), F.lower("text").alias("k"), shown.alias("v"))
    own = rows.groupBy("doc_id", "k").agg(F.min(F.struct("l", "t", "q")).alias("x"), F.max("v").alias("v"))
    own = own.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("_x"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_codes"))
    either = F.array_join(F.transform("_x", lambda x: x["q"]), "|")
    pattern = F.concat(F.lit(r"(?i)(?:\b|(?<=\s)|(?<=^))(?:"), either, F.lit(r")(?:\b|(?=\s)|(?=$))"))
    out = joined(docs, own.select("doc_id", "_codes", pattern.alias("_pattern")), ("doc_id",), "left")
    found = F.when(F.col("_pattern").isNull(), F.array().cast("array<struct<s:int,e:int,t:string>>")).otherwise(scan(F.col("text"), F.col("_pattern")))

    def code(t: Column) -> Column:
        low = F.lower(t)
        own = F.try_element_at(F.col("_codes"), low)
        bare = F.try_element_at(F.col("_codes"), F.regexp_replace(low, "s$", ""))
        return F.when(low.endswith("'s"), F.try_element_at(F.col("_codes"), F.regexp_replace(low, "'s$", ""))).otherwise(F.coalesce(own, F.when(low.endswith("s"), bare)))

    spans = F.filter(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), code(x["t"]).alias("code"))), lambda x: x["code"].isNotNull())
    return out.withColumn("_spans", spans).withColumn("redacted", splice(F.col("text"), F.col("_spans"))).drop("_codes", "_pattern", "_spans")


def verified(docs: DataFrame, entities: DataFrame, text: str = "redacted") -> DataFrame:
    """(doc_id, is_complete): whether all codes of a document's entities are in its text."""
    own = entities.groupBy("doc_id").agg(F.collect_set("code").alias("_codes"))
    return joined(docs.select("doc_id", F.col(text).alias("_text")), own, ("doc_id",)).select("doc_id", F.forall("_codes", lambda x: F.contains(F.col("_text"), x)).alias("is_complete"))


def put_back(docs: DataFrame, rows: DataFrame, text: str = "redacted") -> DataFrame:
    """`docs` with `restored`: the codes, in brackets, of a session's rows (session_id, code, original) replaced one after the other, as they are, the longest first.

    A document meets only the codes that its text holds, not its session's whole mapping. Of several originals of a code the smallest counts.
    """
    docs = identified(docs, text)
    held = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[[^\[\]]*\]"), F.lit(0)))
    asked = docs.select("session_id", "row", F.explode(held).alias("code")).distinct()
    own = joined(asked, rows.groupBy("session_id", "code").agg(F.min("original").alias("original")), ("session_id", "code"))
    own = own.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.length("code")).alias("l"), "code", "original"))).alias("_rows"))
    done = F.aggregate("_rows", F.col(text), lambda t, x: F.replace(t, x["code"], x["original"]))
    return docs.join(own, "row", "left").withColumn("restored", F.coalesce(done, F.col(text))).drop("row", "_rows")


def words_of_csv(lines: DataFrame) -> DataFrame:
    """The user's words (word, type) from lines (line_no, line) of `word,type`: an unknown type is person_other, the last line of a word counts."""
    parts = F.transform(F.split("line", ","), _trimmed)
    rows = lines.select("line_no", F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).alias("type")).filter("word <> ''")
    rows = rows.withColumn("type", F.when(F.col("type").isin(*PREFIXES), F.col("type")).otherwise("person_other"))
    return rows.groupBy(F.lower("word").alias("_l")).agg(F.max_by(F.struct("word", "type"), "line_no").alias("x")).select("x.*")


def csv_of_words(words: DataFrame) -> DataFrame:
    """(line): `word,type`, without regard to case in order."""
    return words.orderBy(F.lower("word"), "word").select(F.concat_ws(",", "word", "type").alias("line"))


def excluded_of_csv(lists: DataFrame) -> DataFrame:
    """Distinct words of comma-separated lists (line), trimmed; they exclude without regard to case."""
    return lists.select(F.explode(F.split("line", ",")).alias("word")).select(_trimmed(F.col("word")).alias("word")).filter("word <> ''").distinct()


def mapping_json(codes: DataFrame) -> DataFrame:
    """(session_id, json): a session's mapping as an array of objects with original and replacement, in order of keys."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("key", "original", F.col("code").alias("replacement")))), lambda x: F.struct(x["original"].alias("original"), x["replacement"].alias("replacement")))
    return codes.groupBy("session_id").agg(F.to_json(rows).alias("json"))


def mapping_of_json(texts: DataFrame) -> DataFrame:
    """(session_id, key, original, code) from such JSON; objects that lack a field are left out, the last of a key counts, and text that isn't JSON raises an error."""
    rows = F.from_json("json", "array<struct<original:string,replacement:string>>", {"mode": "FAILFAST"})
    each = texts.select("session_id", F.posexplode(rows).alias("i", "x")).filter("x.original is not null and x.replacement is not null")
    return each.groupBy("session_id", F.lower(_trimmed(F.col("x.original"))).alias("key")).agg(F.max_by("x", "i").alias("x")).select("session_id", "key", "x.original", F.col("x.replacement").alias("code"))


def mentioned(entities: DataFrame, outputs: DataFrame) -> DataFrame:
    """Entities (session_id, doc_seq, text, code) whose code is in their session's output (session_id, output), one for each text: the first document's."""
    own = outputs.select("session_id", F.explode(F.array_distinct(F.regexp_extract_all("output", F.lit(c.PLACEHOLDER), F.lit(0)))).alias("code"))
    own = own.select("session_id", F.regexp_extract("code", r"\[[^\]]+\]", 0).alias("code")).distinct()
    met = joined(entities, own, ("session_id", "code"), "left_semi")
    return met.groupBy("session_id", F.lower("text").alias("key")).agg(F.min(F.struct("doc_seq", "text", "code")).alias("x")).select("session_id", "key", "x.text", "x.code")


def sources_with_parts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, n_parts) of source documents, and how many parts have no source (doc_id null)."""
    own = docs.select("doc_id").join(parts.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts")), "doc_id", "left")
    lone = parts.filter("doc_id is null").agg(F.count(F.lit(1)).alias("n_parts")).select(F.lit(None).cast("long").alias("doc_id"), "n_parts").filter("n_parts > 0")
    return own.na.fill(0, ["n_parts"]).unionByName(lone)


def mention_at(mentions: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions (doc_id, at) with the first mention that holds them, s <= at < e; mentions of a document are gathered once."""
    own = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "text"))).alias("_m"))
    hit = lambda: F.get(F.filter("_m", lambda m: (m["s"] <= F.col("at")) & (F.col("at") < m["e"])), F.lit(0))
    return joined(positions, own, ("doc_id",), "left").select("doc_id", "at", hit()["text"].alias("text"))
