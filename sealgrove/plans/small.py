"""Queries on counts, prompts, formats, paths, orders and codes, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sealgrove.functions import codes as c
from sealgrove.functions import dates
from sealgrove.functions import text as ft
from sealgrove.plans.notes import DATE, notes
from sealgrove.plans.notes import SQL as NOTES
from sealgrove.sources.tables import read_table, spread

TEMPLATE = "case conv_id % 3 when 0 then '' when 1 then chr(10) || '  ' || chr(10) else 'Role' || chr(10) end || text || chr(10) || '  Tone: {formality_text}' || chr(10) || chr(10) || ' ' || chr(10) || 'Ask {detail_text} {formality_text}' || chr(10) || chr(10)"
TITLED = "case o_orderkey % 6 when 0 then 'Dr. ' when 1 then 'DR ' when 2 then 'Professor ' when 3 then 'Mrs.' when 4 then 'Drake ' else 'prof.  ' end || ('N' || cast(o_orderkey as string))"
PATH = "case page_id % 5 when 0 then '/memories/../' when 1 then '/memories' when 2 then '/%2e%2e%2f/' when 3 then '..\\\\..\\\\' else '' end || url"
CODE = "'[' || case doc_id % 3 when 0 then 'PERSON' when 1 then 'CLIENT' else 'DATE' end || '_' || chr(cast(65 + doc_id % 26 as int)) || case doc_id % 5 when 0 then '_FIRST_LAST' when 1 then '_FIRST' when 2 then '_FULL' when 3 then '_FORMAL' else '' end || ']'"
MODES = ("patterns", "model", "both")


def _documents(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def text_counts(spark, sf_dir):
    """Sizes of documents and what is estimated from them."""
    t, words = F.col("text"), ft.word_count(F.col("text"))
    return _documents(spark, sf_dir).select(
        "doc_id", ft.occurrences_of(t, "the").alias("n_the"), words.alias("words"), ft.dense_length(t).alias("dense"), ft.token_estimate(t).alias("tokens"), ft.summary_points(t).alias("points"),
        *(ft.seconds_estimate(words, m).alias(f"seconds_{m}") for m in MODES), (F.length(t) >= ft.LONG_TEXT).alias("is_long"), F.length(F.left(t, F.lit(ft.HEAD))).cast("long").alias("head"),
    )


def prompt_fill(spark, sf_dir):
    """Templates of turns: filled, without their style, and with it again."""
    t = read_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{TEMPLATE} as template")
    bare = ft.without_style(F.col("template"))
    done = ft.filled(F.col("template"), {"formality_text": F.col("role"), "detail_text": F.lit("all")})
    return t.select("conv_id", "turn", done.alias("filled"), bare.alias("bare"), ft.with_style(F.col("template")).alias("styled"))


def model_titles(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{TITLED} as name").select("o_orderkey", ft.strip_model_title(F.col("name")).alias("name"))


def formatted_values(spark, sf_dir):
    size = (F.col("o_orderkey") * F.col("o_custkey") * 37).cast("long")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", ft.shown_seconds(F.col("o_orderkey") / 8).alias("seconds"), ft.shown_share((F.col("o_orderkey") % 1000) / 1024).alias("share"), ft.shown_size(size).alias("size"))


def joined_documents(spark, sf_dir):
    """A conversation's turns as documents of a prompt, each under its name and description."""
    name = F.concat(F.lit("=== "), F.concat(F.lit("Turn "), F.col("turn")), F.when(F.col("role") == "user", F.lit(" (user)")).otherwise(""), F.lit(" ===\n\n"), "text")
    docs = read_table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", name.alias("doc")).alias("d"))
    return docs.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["doc"]), "\n\n").alias("prompt"))


def memory_paths(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").selectExpr("page_id", f"{PATH} as path").select("page_id", ft.clean_path(F.col("path")).alias("path"))


def index_file(spark, sf_dir):
    """An index of each conversation's turns, as the file that lists sub-documents."""
    entry = F.concat(
        F.lit("## DOC_"), F.col("turn"), F.lit(": "), F.col("role"), F.lit("\n**Type:** Turn | **Date:** Not specified | **File:** doc_"), F.col("turn"), F.lit("_content.md\n\n"),
        F.left("text", F.lit(20)), F.lit("\n\n---\n"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", entry.alias("x")).alias("d"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["x"]), "")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("# Document Summaries\n\n"), body).alias("index"))


def line_window(spark, sf_dir):
    """Lines 2 to 4 of a document's text, or all from 2 on of every third document."""
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    last = F.when(F.col("doc_id") % 3 == 0, F.lit(2**31 - 1)).otherwise(4)
    return lines.filter(F.col("line_no").between(F.lit(2), last) & (F.col("line_no") <= 301)).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"))


def date_checks(spark, sf_dir):
    """Whether strings look like dates, and what they are as dates."""
    x = spread(read_table(spark, sf_dir, "orders")).selectExpr("o_orderkey", f"case o_orderkey % 7 when 3 then 'on ' || ({DATE}) else ({DATE}) end as x")
    return x.select("o_orderkey", dates.looks_like_date(F.col("x")).alias("is_date"), dates.normalize(F.col("x")).alias("normal"))


def markdown_blocks(spark, sf_dir):
    """Kinds of lines of documents, with marks put before some."""
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    mark = "case (doc_id + i) % 11 when 0 then '# ' when 1 then '## ' when 2 then '### ' when 3 then '- ' when 4 then '7. ' when 5 then '| ' when 6 then '> ' else '' end || line"
    return lines.selectExpr("doc_id", "i", f"{mark} as line").withColumn("kind", ft.block_kind(F.col("line"))).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def code_parts(spark, sf_dir):
    """Base, variant and whether a code is an anchor's."""
    rows = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{CODE} as code")
    variant, person = c.variant_of(F.col("code")), ~F.startswith("code", F.lit("[DATE"))
    anchor = ~person | variant.isNull() | variant.isin("FULL", "FIRST_LAST")
    return rows.select("doc_id", "code", c.base_of(F.col("code")).alias("base"), F.coalesce(variant, F.lit("-")).alias("variant"), anchor.alias("is_anchor"))


def sorted_names(spark, sf_dir):
    """Places of distinct names: without regard to case, and long ones first."""
    names = notes(spark, sf_dir).select("session_id", F.col("person").alias("name")).distinct()
    by = Window.partitionBy("session_id")
    return names.withColumn("by_name", F.row_number().over(by.orderBy(F.lower("name"), "name"))).withColumn("by_length", F.row_number().over(by.orderBy(F.desc(F.length("name")), "name")))


QUERIES = {f.__name__: f for f in (text_counts, prompt_fill, model_titles, formatted_values, joined_documents, memory_paths, index_file, line_window, date_checks, markdown_blocks, code_parts, sorted_names)}
_STYLE = "chr(10) || 'Tone: {formality_text}' || chr(10) || 'Detail: {detail_text}' || chr(10) || 'Structure: {structure_text}' || chr(10)"


ORACLES = {
    "text_counts": """select doc_id, (len(string_split(text, 'the')) - 1)::bigint as n_the, words, length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', '', 'g'))::bigint as dense, length(text) // 4 as tokens,
        greatest(10, least(50, length(text) // 10000 * 10 + 10))::bigint as points, 1::bigint as seconds_patterns, (30 + floor(words / 3.5))::bigint as seconds_model, (35 + floor(words / 3.5))::bigint as seconds_both,
        length(text) >= 100000 as is_long, least(length(text), 50000)::bigint as head
      from (select *, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+'))::bigint as words from documents)""",
    "prompt_fill": f"""with t as (select conv_id, turn, role, {TEMPLATE} as template, string_split({TEMPLATE}, chr(10)) as lines from conversations),
      kept as (select *, list_filter(lines, lambda x: not starts_with(trim(x, ' ' || chr(9)), 'Tone: {{formality_text}}')) as k, list_transform(lines, lambda x: trim(x, ' ' || chr(9)) <> '') as full_lines from t)
      select conv_id, turn, replace(replace(template, '{{formality_text}}', role), '{{detail_text}}', 'all') as filled,
        array_to_string(list_transform(list_filter(range(1, len(k) + 1), lambda i: not (i > 1 and trim(k[i], ' ' || chr(9)) = '' and trim(k[i - 1], ' ' || chr(9)) = '')), lambda i: k[i]), chr(10)) as bare,
        array_to_string(lines[:list_position(full_lines, true)], chr(10)) || chr(10) || {_STYLE} || case when len(lines) > list_position(full_lines, true) then chr(10) || array_to_string(lines[list_position(full_lines, true) + 1:], chr(10)) else '' end as styled
      from kept""",
    "model_titles": """select o_orderkey, case when o_orderkey % 6 = 4 then 'Drake ' || ('N' || cast(o_orderkey as string)) else ('N' || cast(o_orderkey as string)) end as name from orders""",
    "formatted_values": """select o_orderkey, format('{:.2f} seconds', o_orderkey / 8) as seconds, format('{:.1f}%', (o_orderkey % 1000) / 1024 * 100) as share,
        case when n < 1024 then n || 'B' when n < 1048576 then format('{:.1f}K', n / 1024) else format('{:.1f}M', n / 1048576) end as size from (select *, o_orderkey * o_custkey * 37 as n from orders)""",
    "joined_documents": """select conv_id, string_agg('=== Turn ' || turn || case when role = 'user' then ' (user)' else '' end || ' ===' || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn) as prompt
      from conversations group by conv_id""",
    "memory_paths": "select page_id, case when page_id % 5 = 2 then '/' || url else url end as path from pages",
    "index_file": """select conv_id, '# Document Summaries' || chr(10) || chr(10) || string_agg('## DOC_' || turn || ': ' || role || chr(10) || '**Type:** Turn | **Date:** Not specified | **File:** doc_' || turn
        || '_content.md' || chr(10) || chr(10) || left(text, 20) || chr(10) || chr(10) || '---' || chr(10), '' order by turn) as index from conversations group by conv_id""",
    "line_window": """select doc_id, i::int as line_no, md5(x) as digest from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
      where i >= 2 and i <= 301 and (doc_id % 3 = 0 or i <= 4)""",
    "date_checks": f"""select o_orderkey, o_orderkey % 7 <> 3 and o_orderkey % 6 <> 1 as is_date,
        case when o_orderkey % 7 = 3 or o_orderkey % 6 = 1 then x else strftime(o_orderdate, '%d/%m/%Y') end as normal
      from (select *, case o_orderkey % 7 when 3 then 'on ' || ({DATE}) else ({DATE}) end as x from orders)""",
    "markdown_blocks": """with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)
      select doc_id, kind, count(*) as n from (select doc_id, case (doc_id + i) % 11 when 0 then 'h1' when 1 then 'h2' when 2 then 'h3' when 3 then 'list' when 4 then 'numbered' when 5 then 'table' when 6 then 'callout' else
        case when regexp_matches(x, '^### ') then 'h3' when regexp_matches(x, '^## ') then 'h2' when regexp_matches(x, '^# ') then 'h1' when regexp_matches(x, '^(?:---+|\\*\\*\\*+|___+)\\s*$') then 'rule'
          when regexp_matches(x, '^\\|') then 'table' when regexp_matches(x, '^> ') then 'callout' when regexp_matches(x, '^\\s*[-*•] ') then 'list' when regexp_matches(x, '^\\s*\\d+\\. ') then 'numbered'
          when regexp_matches(x, '^\\s*$') then 'blank' else 'text' end end as kind from l) group by all""",
    "code_parts": f"""select doc_id, {CODE} as code, case doc_id % 3 when 0 then 'PERSON' when 1 then 'CLIENT' else 'DATE' end || '_' || chr((65 + doc_id % 26)::int) as base,
        case doc_id % 5 when 0 then 'FIRST_LAST' when 1 then 'FIRST' when 2 then 'FULL' when 3 then 'FORMAL' else '-' end as variant, doc_id % 3 = 2 or doc_id % 5 in (0, 2, 4) as is_anchor from documents""",
    "sorted_names": f"""with names as (select distinct session_id, person as name from ({NOTES}))
      select *, row_number() over (partition by session_id order by lower(name), name)::int as by_name, row_number() over (partition by session_id order by length(name) desc, name)::int as by_length from names""",
}
