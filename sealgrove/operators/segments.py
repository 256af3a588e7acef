"""Segmentation of texts, label runs, model answers and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.functions.scan import let

CHUNK, OVERLAP, LOOK_BACK = 8000, 200, 500


def _last(part: Column, separator: str) -> Column:
    """Characters up to the end of the last separator of a text, or 0."""
    back = F.instr(F.reverse(part), separator[::-1])
    return F.when(back > 0, F.length(part) - back + 1).otherwise(0)


def chunk_ends(text: Column, size: int = CHUNK, look_back: int = LOOK_BACK) -> Column:
    """Ends of consecutive chunks: at most `size` characters, cut after a sentence, else a blank line, else a line, else anywhere."""
    n = F.length(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at, goal = acc["at"], acc["at"] + size
        part = F.substring(text, goal - look_back + 1, F.lit(look_back))
        cut = F.coalesce(*(F.when(_last(part, s) > 0, goal - look_back + _last(part, s)) for s in (". ", "\n\n", "\n")), goal)
        end = F.when(goal >= n, n).otherwise(cut)
        return F.when(at >= n, acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(end)).alias("out")))

    steps = F.sequence(F.lit(0), F.floor(n / (size - look_back)).cast("int") + 1)
    return F.when(n <= size, F.array(n)).otherwise(F.aggregate(steps, start, step, lambda acc: acc["out"]))


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, global_offset, overlap_before, overlap_after, text). Chunks are cut in the document's row, so that a text isn't copied for each of them."""
    n, text = F.length("text"), F.col("text")

    def cut(ends: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
            offset, stop = F.greatest(F.lit(0), begin - overlap), F.least(n, end + overlap)
            return F.struct(k.alias("chunk_no"), offset.alias("global_offset"), (begin - offset).alias("overlap_before"), (stop - end).alias("overlap_after"), F.substring(text, offset + 1, stop - offset).alias("text"))

        return F.transform(ends, chunk)

    return docs.select("doc_id", F.inline(let(chunk_ends(text, size), cut)))


def model_windows(docs: DataFrame, size: int = 2000, step: int = 1800, least: int = 100) -> DataFrame:
    """Windows for a model: a text of up to `size` characters is one, others begin a step apart as long as more than `least` characters remain.

    A window that isn't the last ends after the last sentence, else line, that ends in what it shares with the next. Windows are told in the document's row.
    """
    n, text = F.length("text"), F.col("text")
    last = F.when(n <= size, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((n - least - 1) / step))).cast("int")

    def window(k: Column) -> Column:
        s = k * step
        cut = let(F.substring(text, s + step + 1, F.lit(size - step)), lambda shared: F.coalesce(*(F.when(_last(shared, x) > 0, step + _last(shared, x)) for x in (". ", "\n")), F.lit(size)))
        return F.struct(k.alias("chunk_no"), s.alias("s"), F.when(s + size >= n, n).otherwise(s + cut).alias("e"))

    return docs.select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), last), window)))


def packed(pieces: Column, most: int) -> Column:
    """Pieces gathered in order into packs of at most `most` characters, separators of two included; a longer piece is a pack of its own."""
    start = F.struct(F.lit(-1).alias("n"), F.array().cast("array<struct<pieces:int,chars:int>>").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        joined = acc["n"] + 2 + F.length(x)
        fits = (acc["n"] >= 0) & (joined <= most)
        closed = F.when((acc["n"] < 0) | fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["k"].alias("pieces"), acc["n"].alias("chars")))))
        return F.struct(F.when(fits, joined).otherwise(F.length(x)).alias("n"), closed.alias("out"), F.when(fits, acc["k"] + 1).otherwise(1).alias("k"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["n"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["k"].alias("pieces"), acc["n"].alias("chars"))))))


def label_runs(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of B- and I- labels: B starts one, I of another type too, I without an open span is dropped, O closes. `tokens` has tok and label."""
    order = Window.partitionBy(*keys).orderBy("tok")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    kind, is_b = F.regexp_extract("label", "^[BI]-(.+)$", 1), F.col("label").startswith("B-")
    t = tokens.withColumn("_kind", kind).withColumn("_part", F.sum(F.when(F.col("_kind") == "", 1).otherwise(0)).over(upto))
    in_part = Window.partitionBy(*keys, "_part").orderBy("tok")
    t = t.filter("_kind <> ''").withColumn("_open", F.sum(F.when(is_b, 1).otherwise(0)).over(in_part.rowsBetween(Window.unboundedPreceding, 0))).filter("_open > 0")
    new = is_b | (F.coalesce(F.lag("_kind").over(in_part), F.lit("")) != F.col("_kind"))
    t = t.withColumn("_span", F.sum(F.when(new, 1).otherwise(0)).over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "_part", "_span", F.col("_kind").alias("type")).agg(F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok")).drop("_part", "_span")


def bridged(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Neighbouring spans of a document joined where 1 to 29 characters of capitalised words lie between them; the least confidence counts."""
    order = Window.partitionBy("doc_id").orderBy("s")
    t = spans.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").withColumn("_prev", F.lag("e").over(order))
    gap = F.expr("substring(_text, _prev + 1, s - _prev)")
    names = F.filter(F.split(gap, r"\s+"), lambda x: x != "")
    joins = (F.col("s") - F.col("_prev")).between(1, 29) & F.forall(names, lambda x: x.rlike("^[A-Z].+"))
    t = t.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("_text")
    t = t.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("doc_id", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")).drop("_run")


def last_turns(conversations: DataFrame, keep: int = 10, threshold: int = 50) -> DataFrame:
    """All turns of short conversations, the last `keep` of those with more than `threshold`."""
    by = Window.partitionBy("conv_id")
    out = conversations.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_k", F.row_number().over(by.orderBy(F.desc("turn"))))
    return out.filter(f"_n <= {threshold} or _k <= {keep}").drop("_n", "_k")


def normal_line(x: Column) -> Column:
    return F.regexp_replace(F.btrim(x, F.lit(" \t")), r"\s+", " ")


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, line_no): lines of new texts that aren't blank and, normalised, are in no line of the old text of that id."""
    was = old.select("id", F.explode(F.transform(F.split("text", "\n"), normal_line)).alias("line")).distinct()
    now = new.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", normal_line(F.col("line"))).filter("line <> ''")
    return now.join(was, ["id", "line"], "left_anti").select("id", "line_no")


def routed(answers: DataFrame, text: str = "text") -> DataFrame:
    """Answers as chat (marked [CONVERSATION]), or as document with, after [REVIEW], a review."""
    t, strip = F.col(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    chat, at = F.startswith(t, F.lit("[CONVERSATION]")), F.instr(t, "[REVIEW]")
    return answers.withColumns({
        "chat": F.when(chat, strip(F.substring(t, 15, 1 << 30))), "document": F.when(~chat, F.when(at > 0, strip(F.substring(t, F.lit(1), at - 1))).otherwise(t)),
        "review": F.when(~chat & (at > 0), strip(F.substring(t, at + 8, F.lit(1 << 30)))),
    })


ANSWER = "struct<entities:array<struct<original:string,replacement:string,type:string,positions:array<array<int>>>>>"
# Types that models name, and what they stand for.
MODEL_TYPES = {
    "person_client": "person_client client_name client patient", "person_provider": "person_provider provider_name provider doctor therapist", "person_other": "person_other other_name person other_person name",
    "date": "date specific_date", "location": "location place address", "organization": "organization org company", "identifier": "identifier id_number id number", "contact": "contact email phone",
}
# Types that findings name, and headings of their sections.
FINDING_TYPES = {"contact": "EMAIL PHONE PHONE_NUMBER CONTACT", "location": "LOCATION ADDRESS", "date": "DATE", "identifier": "ID IDENTIFIER", "organization": "ORGANIZATION ORG"}
SECTIONS = (("name", "NAME"), ("email", "EMAIL"), ("phone", "PHONE"), ("location", "LOCATION"), ("date", "DATE"), ("organization", "OTHER"), ("address", "LOCATION"), ("medical", "OTHER"))


def _mapped(x: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(v) for k, names in table.items() for n in names.split() for v in (n, k)))[x]


def parse_answers(answers: DataFrame) -> DataFrame:
    """Entities of model answers in JSON, fenced or not: a row for each position; unknown types and empty fields are skipped."""
    body = F.from_json(F.regexp_extract("json", r"(?s)\{.*\}", 0), ANSWER)
    rows = answers.select("doc_id", F.explode(body["entities"]).alias("x")).select("doc_id", "x.*").withColumn("type", _mapped(F.lower(F.trim("type")), MODEL_TYPES))
    rows = rows.filter("original <> '' and replacement <> '' and type is not null")
    none = F.array(F.array(F.lit(0), F.lit(0)))
    return rows.select("doc_id", "original", "replacement", "type", F.explode(F.when(F.size("positions") > 0, F.col("positions")).otherwise(none)).alias("p")).select("doc_id", "original", "replacement", "type", F.get("p", F.lit(0)).alias("s"), F.get("p", F.lit(1)).alias("e"))


def parse_findings(answers: DataFrame) -> DataFrame:
    """Findings of model answers in lines: TYPE|text|reason, or bullets below a heading that names their type. The first of equal texts counts."""
    usable = (F.length("text") <= 200) | F.contains("text", F.lit("|")) | F.contains(F.upper("text"), F.lit("NO_ISSUES_FOUND"))
    lines = answers.filter(usable).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.btrim("line"))
    lines = lines.filter((F.col("line") != "") & ~F.contains(F.upper("line"), F.lit("NO_ISSUES_FOUND")))
    parts, lower = F.split("line", "\\|"), F.lower("line")
    piped, bullet = F.size(parts) >= 2, F.col("line").rlike("^[-•]")
    heading = F.coalesce(*(F.when(F.contains(lower, F.lit(k)), F.lit(v)) for k, v in SECTIONS))
    lines = lines.withColumn("_head", F.when(~piped, heading))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_section", F.last("_head", ignorenulls=True).over(upto))
    bold = F.regexp_extract(F.upper(F.btrim(F.get(parts, F.lit(0)))), r"\*\*(.+?)\*\*", 1)
    item = F.btrim(F.regexp_replace("line", "^[-•]", ""))
    text = F.when(piped, F.when(bold != "", bold).otherwise(F.btrim(F.get(parts, F.lit(1))))).when(bullet & F.col("_head").isNull(), F.regexp_extract(item, r"(?s)^(.*?)(?: \(|$)", 1))
    reason = F.when(piped, F.coalesce(F.btrim(F.get(parts, F.lit(2))), F.lit("Potential PII detected"))).otherwise(F.coalesce(F.nullif(F.regexp_extract(item, r" \(([^)]*)\)", 1), F.lit("")), F.lit("Detected by LLM")))
    inferred = F.when(F.contains(text, F.lit("@")), "EMAIL").when(text.rlike(r"^[\d\- ()]+$"), "PHONE").otherwise("NAME")
    named = F.when(piped, F.when(bold != "", "NAME").otherwise(F.upper(F.btrim(F.get(parts, F.lit(0)))))).otherwise(F.coalesce("_section", inferred))
    found = lines.select("doc_id", "line_no", text.alias("finding"), named.alias("_named"), reason.alias("reason"), (~piped & F.contains(text, F.lit("_"))).alias("_code"))
    found = found.filter(F.col("finding").isNotNull() & (F.length("finding") > 1) & ~F.col("finding").rlike(r"\[[^\]]+\]") & ~F.startswith("finding", F.lit("[")) & ~F.coalesce("_code", F.lit(False)) & (F.col("_named") != "TITLE"))
    found = found.withColumn("type", F.coalesce(_mapped(F.col("_named"), FINDING_TYPES), F.lit("person_other"))).withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", F.lower("finding")).orderBy("line_no")))
    return found.filter("_k = 1").select("doc_id", "line_no", "finding", "type", "reason")
