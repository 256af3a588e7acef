"""Queries on sub-word units, tool calls, layered settings, versions of documents and Markdown, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealgrove.operators import markdown as md
from sealgrove.operators import settings as st
from sealgrove.operators import subwords as sw
from sealgrove.operators import versions as ve
from sealgrove.operators.conversations import pruned
from sealgrove.sources.tables import read_table, spread


def subword_units(spark, sf_dir):
    """Units and windows of documents, over a lexicon of the parts of words of the benchmark."""
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).distinct()
    parts = F.flatten(F.array(F.array(F.concat(F.lit(sw.WORD), "w")), F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.concat(F.lit(sw.WORD), F.substring("w", F.lit(1), k))),
                              F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring("w", k, F.lit(3)))))
    pieces = words.select(F.explode(parts).alias("piece")).distinct().withColumn("id", F.pmod(F.xxhash64("piece"), F.lit(1_000_000)).cast("int"))
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = sw.with_units(docs, sw.vocabulary(pieces))
    found = found.select("doc_id", "units", F.size("units").alias("n_units"))  # before the windows, which would each carry all units
    out = found.select("doc_id", "n_units", F.explode(sw.windows(F.col("units"), shared=16)).alias("w"))
    ids, mask = sw.model_input(F.col("w.units"), 0, 2, 1)
    return out.select("doc_id", "n_units", F.col("w.window").alias("window"), F.get("w.units", F.lit(0))["s"].alias("s"), F.try_element_at("w.units", F.lit(-1))["e"].alias("e"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n"), F.xxhash64(ids).alias("ids"))


_KIND = "case when turn % 3 = 1 then 'call' when turn % 3 = 2 then 'result' else 'text' end"
_CALL = "concat('c', cast(turn - turn % 3 as string))"


def tool_pruning(spark, sf_dir):
    """The messages that are kept of conversations longer than four, results with their calls."""
    messages = read_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_KIND} as kind", f"{_CALL} as call_id", "text")
    return pruned(messages, 4).select("conv_id", "turn", "kind", F.length("text").cast("long").alias("n_chars"))


_PATH = "concat('a', {k} % 3, case when {k} % 4 > 0 then concat('.b', {k} % 5) else '' end, case when {k} % 4 > 1 then concat('.c', {k} % 2) else '' end)"


def _layers(spark, sf_dir):
    built_in = read_table(spark, sf_dir, "part").selectExpr("concat('t', p_partkey % 7) as type_id", f"{_PATH.format(k='p_partkey')} as path", "p_name as value")
    own = read_table(spark, sf_dir, "customer").selectExpr("c_custkey % 40 as user_id", "concat('t', c_custkey % 9) as type_id", f"{_PATH.format(k='(c_custkey * 5)')} as path", "case when c_custkey % 6 > 0 then c_name end as value")
    return built_in, own


def layered_settings(spark, sf_dir):
    """Users' settings by type, with what is theirs."""
    return st.layered(*_layers(spark, sf_dir))


def settings_prompts(spark, sf_dir):
    """Prompts of users' types over their documents: a preface and instructions from layered settings."""
    named = F.when(F.col("path") == "a0", "preface").when(F.startswith("path", F.lit("a1")), F.concat(F.lit("instructions."), "path"))
    layered = st.layered(*_layers(spark, sf_dir)).withColumn("path", named).filter("path is not null")
    titles = read_table(spark, sf_dir, "orders").selectExpr("o_custkey % 40 as user_id", "concat('t', o_orderkey % 9) as type_id", "o_orderpriority as title", "o_orderkey as at").filter("at % 5 = 0")
    return st.prompts(layered, titles)


_CHANGES = {
    "session_id": "cast(user_id % 30 as string)", "at": "event_id", "kind": "split_part('draft,save,draft,describe,save,delete,save,clear,draft,save', ',', cast(event_id * 7 % 10 + 1 as int))",
    "doc_id": "event_id * 3 % 5", "text": "concat('v', cast(event_id as string))",
}


def document_versions(spark, sf_dir):
    """What holds at every fiftieth change: drafts, saved documents and their descriptions."""
    changes = read_table(spark, sf_dir, "events").selectExpr(*(f"{x} as `{name}`" for name, x in _CHANGES.items()))
    return ve.state_at(ve.versions(changes), changes.filter("at % 50 = 0").select("session_id", "at"))


_MARKDOWN = """concat('# Order **', o_orderkey, '** of _', o_orderstatus, '_\n\nPaid ***', o_orderpriority, '*** by [PERSON_A_FIRST] and snake_case_x\n- `a*b', o_custkey, '*` item\n  1. in *Clerk', o_custkey % 100,
  '* and ** no**\n- __', o_custkey % 7, '__\n\n| a | *b* |\n---')"""


def markdown_runs(spark, sf_dir):
    """Blocks and runs of notes written in Markdown."""
    found = md.with_markdown(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_MARKDOWN).alias("text")))
    kinds = F.transform("blocks", lambda b: F.concat_ws(":", b["block"], b["kind"], b["level"]))
    runs = F.transform(md.plain(F.col("text"), F.col("runs")), lambda r: F.concat_ws("=", r["style"], r["text"]))
    return found.select("doc_id", F.array_join(kinds, " ").alias("blocks"), F.array_join(runs, "|").alias("runs"))


QUERIES = {f.__name__: f for f in (subword_units, tool_pruning, layered_settings, settings_prompts, document_versions, markdown_runs)}

_LAYERS = f"""built_in as (select type_id, path, max(value) as value from (select concat('t', p_partkey % 7) as type_id, {_PATH.format(k='p_partkey')} as path, p_name as value from part) group by all),
  given as (select user_id, type_id, path, max(value) as value from (select c_custkey % 40 as user_id, concat('t', c_custkey % 9) as type_id, {_PATH.format(k='(c_custkey * 5)')} as path, case when c_custkey % 6 > 0 then c_name end as value from customer) group by all),
  own as (from given o where value is null or not exists (from given x where x.user_id = o.user_id and x.type_id = o.type_id and x.value is not null and starts_with(x.path, o.path || '.'))),
  layered as (
    select user_id, type_id, path, value, 'user' as source from own where value is not null
    union all select user_id, type_id, b.path, b.value, 'built-in' from (select distinct user_id, type_id from own) join built_in b using (type_id)
    where not exists (from own o where o.user_id = user_id_ and o.type_id = b.type_id and (o.path = b.path or starts_with(b.path, o.path || '.') or o.value is not null and starts_with(o.path, b.path || '.'))))"""
_LAYERS = _LAYERS.replace("(select distinct user_id, type_id from own) join", "(select distinct user_id, user_id as user_id_, type_id from own) t join")
_CHANGE_SQL = "select " + ", ".join(f'{x} as "{name}"' for name, x in _CHANGES.items()) + " from events"
ORACLES = {
    "tool_pruning": f"""with m as (select conv_id, turn, {_KIND} as kind, {_CALL} as call_id, length(text) as n_chars, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n from conversations)
      select conv_id, turn, kind, n_chars from m where n <= 4 or i = 1 or i > n - 3 or kind = 'call' and exists (from m r where r.conv_id = m.conv_id and r.i = r.n - 2 and r.kind = 'result' and r.call_id = m.call_id and m.i < r.i)""",
    "layered_settings": f"with {_LAYERS} select * from layered",
    "settings_prompts": f"""with {_LAYERS}, heads as (select user_id, type_id, string_agg(case when path = 'a0' then value else '- ' || value end, chr(10) order by path <> 'a0', path) as head from layered where path = 'a0' or starts_with(path, 'a1') group by all),
      titles as (select user_id, type_id, string_agg(i || '. ' || title, chr(10) order by i) as list, count(*) as n from (select o_custkey % 40 as user_id, concat('t', o_orderkey % 9) as type_id, o_orderpriority as title,
        row_number() over (partition by o_custkey % 40, o_orderkey % 9 order by o_orderkey) as i from orders where o_orderkey % 5 = 0) group by all)
      select user_id, type_id, concat_ws(chr(10), head, case when n > 1 then 'Documents:' || chr(10) || list end) as prompt from titles left join heads using (user_id, type_id)""",
    "document_versions": f"""with c as materialized ({_CHANGE_SQL}), steps as (select session_id, "at" as now from c where "at" % 50 = 0),
      lasts as (select s.*, (select max({{'at': c."at", 'kind': c.kind, 'doc_id': c.doc_id, 'text': c.text}}) from c where c.session_id = s.session_id and c."at" <= now and kind in ('draft', 'clear')) as d from steps s),
      real as (select *, (select max({{'at': x."at", 'kind': x.kind, 'doc_id': x.doc_id, 'text': x.text}}) from c x where x.session_id = c.session_id and x."at" < c."at" and x.kind in ('draft', 'clear')) as d from c where kind = 'save'),
      saves as (select session_id, "at", doc_id, d.text as text from real where d.kind = 'draft' and d.doc_id = doc_id),
      turns as (select session_id, "at", doc_id, 'save' as kind, text from saves union all select session_id, "at", doc_id, 'delete', null from c where kind = 'delete'),
      held as (select s.session_id, now, t.doc_id, max({{'at': t."at", 'kind': t.kind, 'text': t.text}}) as x from steps s join turns t on s.session_id = t.session_id and t."at" <= now group by all),
      told as (select c.session_id, c."at", c.doc_id, c.text, (select max({{'at': t."at", 'kind': t.kind}}) from turns t where t.session_id = c.session_id and t.doc_id = c.doc_id and t."at" < c."at") as b from c where kind = 'describe'),
      said as (select s.session_id, now, t.doc_id, max({{'at': t."at", 'text': t.text}}) as x from steps s join told t on s.session_id = t.session_id and t."at" <= now and b.kind = 'save' group by all)
      select session_id, now as "at", 'draft' as item, d.doc_id as doc_id, d.text as text from lasts where d.kind = 'draft'
      union all select session_id, now, 'saved', doc_id, x.text from held where x.kind = 'save'
      union all select session_id, now, 'described', doc_id, x.text from said where not exists (from c where c.session_id = said.session_id and c.doc_id = said.doc_id and kind = 'delete' and c."at" > x."at" and c."at" <= now)""",
    "markdown_runs": """select o_orderkey as doc_id, '0:heading:1 1:paragraph:0 2:bullet:1 2:number:2 2:bullet:1 3:table:0 4:rule:0' as blocks,
      concat('strong=', o_orderkey, '|emphasis=', o_orderstatus, '|strong emphasis=', o_orderpriority, '|code=a*b', o_custkey, '*|emphasis=Clerk', o_custkey % 100, '|strong=', o_custkey % 7, '|emphasis=b') as runs from orders""",
}
