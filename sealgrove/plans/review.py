"""Queries on the second pass: findings, merging, parts of names, leaks, statistics, steps after a name model; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealgrove.functions import words as w
from sealgrove.operators import names as on
from sealgrove.operators import review as rv
from sealgrove.operators.recognizers import Rule, mentions
from sealgrove.plans.detection import _quote, sql_scan
from sealgrove.plans.entities import _ALL, ON_NOTES, _all, _coded, _found
from sealgrove.plans.notes import FIRST, LAST, notes
from sealgrove.plans.notes import SQL as NOTES
from sealgrove.sources.tables import written

FIRST_RULE = Rule("first", 0, 0, r"\b(?:" + FIRST.replace(",", "|") + r")\b", "person_other", 0.9)
LAST_RULE = Rule("last", 0, 0, r"\b(?:" + LAST.replace(",", "|") + r")\b", "person_other", 0.9)
TERMS = ("High Street", "seen", "Prof", "Phone 021", "colour")


def _findings(docs):
    return docs.select("session_id", "doc_id", F.explode(F.array_distinct(on.capitalised(F.col("text")))).alias("text"))


def delta_findings(spark, sf_dir):
    """Capitalised words of notes that no mention covers in any way."""
    return rv.new_findings(_findings(notes(spark, sf_dir)).select("doc_id", "text"), _found(spark, sf_dir))


def union_findings(spark, sf_dir):
    """Detected entities but for some, the user's, and a model's that aren't known."""
    kept = written(_found(spark, sf_dir).select("doc_id", "text", "type"), "mentions")
    removed = kept.filter("length(text) % 7 = 0")
    custom = notes(spark, sf_dir).filter("doc_id % 10 = 0").selectExpr("doc_id", "person as text", "'person_client' as type")
    found = rv.not_known(_findings(notes(spark, sf_dir)).select("doc_id", "text"), kept).withColumn("type", F.lit("person_other"))
    return rv.all_entities(kept, removed, custom=custom, model=found)


def resolve_types(spark, sf_dir):
    """One type for each text of a note, over all mentions."""
    return rv.best_types(_all(spark, sf_dir))


def ai_pattern_merge(spark, sf_dir):
    """Names that a model finds, and patterns' mentions."""
    model = notes(spark, sf_dir).selectExpr("doc_id", "person as text", "'person_client' as type", "cast(case doc_id % 3 when 0 then null when 1 then 0.95 else 0.5 end as double) as confidence")
    return rv.model_and_patterns(model, _found(spark, sf_dir).select("doc_id", "text", "type", "confidence"))


def component_entities(spark, sf_dir):
    """Where the parts of sessions' full names occur."""
    codes = _coded(spark, sf_dir)[1]
    parts = rv.name_parts(codes.filter("anchor").select("session_id", F.col("original").alias("name")))
    found = rv.occurrences_of_terms(notes(spark, sf_dir), parts.select("session_id", F.col("text").alias("term")).distinct())
    return found.select("doc_id", "s", "e", "text", F.lower("term").alias("term")).distinct()


def find_occurrences(spark, sf_dir):
    terms = notes(spark, sf_dir).select("session_id").distinct().select("session_id", F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return rv.occurrences_of_terms(notes(spark, sf_dir), terms)


def leak_merge(spark, sf_dir):
    """Findings with a code in them, and letters that leaked behind it."""
    found = notes(spark, sf_dir).selectExpr("session_id", "doc_id", "case doc_id % 3 when 0 then '[PERSON_A]son' when 1 then 'near [PERSON_B]ie there' else '[PERSON_C] alone' end as text")
    return rv.leaked_names(found, _coded(spark, sf_dir)[1])


def session_stats(spark, sf_dir):
    """Codes of sessions by type."""
    return rv.session_statistics(_coded(spark, sf_dir)[1])


def name_extension(spark, sf_dir):
    """First names with the surname behind them, surnames with the name word before them."""
    docs = notes(spark, sf_dir)
    found = mentions(docs, (FIRST_RULE, LAST_RULE)).select("doc_id", "s", "e", "text")
    return rv.extended_names(docs, found)


def plausible_names(spark, sf_dir):
    """Names of three words and more, some with particles or small words within."""
    names = notes(spark, sf_dir).selectExpr("doc_id", "split_part(person, ' ', 1) || case doc_id % 4 when 0 then ' van der ' when 1 then ' van ' when 2 then ' saw ' else ' ' end || split_part(person, ' ', 2) as text")
    return rv.plausible_names(names)


def parent_names(spark, sf_dir):
    """Single names with the first full name of their session that has them."""
    people = notes(spark, sf_dir).select("session_id", "person", "doc_seq").groupBy("session_id", "person").agg(F.min("doc_seq").alias("at"))
    single = people.select("session_id", F.explode(F.split("person", " ")).alias("name"), F.lit(0).cast("long").alias("at")).distinct()
    return rv.parents_of(people.withColumnRenamed("person", "name").unionByName(single))


QUERIES = {f.__name__: f for f in (
    delta_findings, union_findings, resolve_types, ai_pattern_merge, component_entities, find_occurrences, leak_merge, session_stats, name_extension, plausible_names, parent_names)}
_WORDS = """seen as (select distinct doc_id, word from (select doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{N}_]+')) as word from notes) where regexp_full_match(word, '[A-Z][a-z]{3,}'))"""
_TYPES = sorted(set(rv.TAGS.values()) | {"date", "contact", "identifier"})
_RANK = "case " + " ".join(f"when type = '{t}' then {-n}" for t, n in rv.PRIORITY.items()) + " else -1 end"
#: Words of notes with what follows them, against terms by session.
_MET = f"""words as (select session_id, doc_id, s from ({sql_scan('notes', Rule('w', 0, 0, '[\\p{L}\\p{N}_]+', '', 1.0), keys='session_id, doc_id')})),
    tried as (select w.doc_id, t.term, w.s, lower(substr(n.text, w.s + 1 + length(t.term), 2)) as tail, n.text as body from words w join terms t on w.session_id = t.session_id
      join notes n on n.doc_id = w.doc_id and lower(substr(n.text, w.s + 1, length(t.term))) = lower(t.term)),
    hits as (select doc_id, term, s::int as s, (s + length(term) + extra)::int as e, substr(body, s + 1, length(term) + extra) as text from (
      select *, case when regexp_matches(tail, '^s([^\\p{{L}}\\p{{N}}_]|$)') then 1 else 0 end as extra from tried) where extra = 1 or not regexp_matches(tail, '^[\\p{{L}}\\p{{N}}_]'))"""
_BEHIND = "regexp_extract(substr(n.text, m.e + 1, 60), '^( +[A-Z][a-z]+)([^\\p{L}\\p{N}_]|$)', 1)"
_BEFORE = "regexp_extract(substr(n.text, greatest(m.s - 39, 1), least(m.s, 40)), '([^\\p{L}.\\n•\\-:;])([A-Z]\\p{L}*) $', 2)"
ORACLES = {
    "delta_findings": ON_NOTES + ", " + _WORDS + """ select doc_id, word as text from seen f where not exists (from kept k where k.doc_id = f.doc_id
      and (contains(lower(k.text), lower(word)) or contains(lower(word), lower(k.text))))""",
    "union_findings": ON_NOTES + ", " + _WORDS + """ select doc_id, text, type, 'detected' as source from kept k where not exists (from kept r where r.doc_id = k.doc_id and r.text = k.text and length(r.text) % 7 = 0)
      union all select doc_id, person, 'person_client', 'custom' from notes where doc_id % 10 = 0
      union all select doc_id, word, 'person_other', 'model' from seen f where not exists (from kept k where k.doc_id = f.doc_id and lower(k.text) = lower(word))""",
    "resolve_types": f"""{_ALL} select doc_id, key, b.type as type, 0 - b.c as confidence from (
      select doc_id, lower(text) as key, min({{'r': {_RANK}, 'c': -confidence, 'type': type}}) as b from m group by 1, 2)""",
    "ai_pattern_merge": ON_NOTES + """, pairs as (select doc_id, person as text, 'person_client' as type, case doc_id % 3 when 0 then 0.0 when 1 then 0.95 else 0.5 end::double as confidence, 0 as o from notes
        union all select doc_id, text, type, confidence, 1 from kept)
      select doc_id, key, b.text as text, b.type as type, 0 - b.c as confidence, b.o = 0 as from_model from (select doc_id, lower(text) as key, min({'c': -confidence, 'o': o, 'type': type, 'text': text}) as b from pairs group by 1, 2)""",
    "component_entities": ON_NOTES + f""", terms as (select distinct session_id, unnest([case when length(first) >= 3 then first end, case when length(last) >= 3 then last end, case when length(middle) >= 2 then middle end,
        case when length(last) >= 3 then coalesce(title, 'Mr') || ' ' || last end]) as term from people), {_MET}
      select distinct doc_id, s, e, text, lower(term) as term from hits""",
    "find_occurrences": f"with notes as ({NOTES}), terms as (select distinct session_id, unnest([{', '.join(map(_quote, TERMS))}]) as term from notes), {_MET} select * from hits",
    "leak_merge": ON_NOTES + """select n.session_id, doc_id, code, original as old, original || case doc_id % 3 when 0 then 'son' else 'ie' end as text
      from notes n join codes c on n.session_id = c.session_id and code = case doc_id % 3 when 0 then '[PERSON_A]' else '[PERSON_B]' end where doc_id % 3 < 2""",
    "session_stats": ON_NOTES + f"""select session_id, {', '.join(f"count(*) filter (where type = '{t}') as {t}" for t in _TYPES)}, count(*) as total,
      list_aggregate(list_sort(list(distinct type)), 'string_agg', ',') as types from codes group by session_id""",
    "name_extension": f"""with notes as ({NOTES}), m as ({sql_scan('notes', FIRST_RULE)} union all {sql_scan('notes', LAST_RULE)}),
      b as (select m.doc_id, m.s, m.e, m.text, {_BEHIND} as behind, {_BEFORE} as lead from m join notes n using (doc_id)),
      x as (select *, case when lower(trim(behind)) in ({', '.join(map(_quote, on.EXCLUDED))}) then '' else behind end as more, case when lower(lead) in ({', '.join(map(_quote, w.NAME_WORDS))}) then lead || ' ' else '' end as name from b)
      select doc_id, (s - length(name))::int as s, (e + length(more))::int as e, name || text || more as text from x""",
    "plausible_names": f"""with notes as ({NOTES}) select doc_id, split_part(person, ' ', 1) || case doc_id % 4 when 1 then ' van ' else ' ' end || split_part(person, ' ', 2) as text from notes where doc_id % 4 in (1, 3)""",
    "parent_names": f"""with people as (select session_id, person, min(doc_seq) as seq from ({NOTES}) group by 1, 2), single as (select distinct session_id, unnest(string_split(person, ' ')) as name from people)
      select s.session_id, name, arg_min(person, {{'a': seq, 'p': person}}) as parent from single s join people p on s.session_id = p.session_id and name in (split_part(person, ' ', 1), split_part(person, ' ', 2)) group by 1, 2""",
}
