"""Queries on names, dates, segments, labels and conversations, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealgrove.functions import dates
from sealgrove.functions import names as fn
from sealgrove.functions.words import VARIANTS
from sealgrove.operators import names as on
from sealgrove.operators import segments as sg
from sealgrove.operators import spans as sp
from sealgrove.operators.recognizers import BY_NAME, mentions
from sealgrove.plans.detection import _quote, sql_scan
from sealgrove.plans.entities import RULES
from sealgrove.plans.notes import _D, _M, _TWO, _Y, DATE, notes
from sealgrove.plans.notes import SQL as NOTES
from sealgrove.sources.tables import read_table, spread

_WITH = f"with notes as ({NOTES})"
NAME = "case doc_id % 4 when 0 then 'Mr ' || person when 1 then split_part(person, ' ', 1) || ' Michael ' || split_part(person, ' ', 2) when 2 then split_part(person, ' ', 2) else 'Prof. ' || person end"
ALIAS = "case doc_id % 9 when 0 then f || ' Michael ' || l when 1 then f || ' ' || l when 2 then upper(f) when 3 then l when 4 then 'Michael' when 5 then 'Dr ' || l when 6 then f || ' Michael' when 7 then substr(f, 1, 3) else 'Nobody' end"


def _documents(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _names(spark, sf_dir):
    return notes(spark, sf_dir).select("session_id", F.col("person").alias("name")).distinct()


def name_parse(spark, sf_dir):
    p = fn.person(F.col("name"))
    return notes(spark, sf_dir).selectExpr("doc_id", f"{NAME} as name").select("doc_id", "name", *(c.alias(k) for k, c in p.items()))


def variant_detect(spark, sf_dir):
    base = notes(spark, sf_dir).selectExpr("doc_id", "split_part(person, ' ', 1) as f", "split_part(person, ' ', 2) as l").selectExpr("doc_id", "f || ' Michael ' || l as full", f"{ALIAS} as alias")
    return base.select("doc_id", "alias", fn.variant_for(F.col("alias"), fn.person(F.col("full")), F.col("full")).alias("variant"))


def mapping_expand_variants(spark, sf_dir):
    """Every variant's text for each person of a session."""
    full = _names(spark, sf_dir)
    v = fn.variants(fn.person(F.col("name")), F.col("name"))
    return full.select("session_id", "name", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v[k].alias("text")) for k in VARIANTS))).alias("x")).select("session_id", "name", "x.*")


def capitalised_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(on.capitalised(F.col("text"))).cast("long").alias("n"))


def fuzzy_names(spark, sf_dir):
    known = _names(spark, sf_dir).select("session_id", F.explode(F.split("name", " ")).alias("name")).distinct()
    return on.fuzzy_matches(on.session_words(notes(spark, sf_dir)), known)


def non_dictionary_words(spark, sf_dir):
    known = _names(spark, sf_dir).select("session_id", F.explode(F.split("name", " ")).alias("name"))
    dictionary = read_table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), on.NOT_WORD)).alias("word")).distinct()
    return on.not_in_dictionary(on.session_words(notes(spark, sf_dir)), known, dictionary)


def known_surname_extend(spark, sf_dir):
    surnames = _names(spark, sf_dir).select("session_id", F.split("name", " ")[1].alias("surname")).distinct()
    return on.surname_pairs(notes(spark, sf_dir), surnames)


def occurrence_scan(spark, sf_dir):
    return on.occurrences(notes(spark, sf_dir), _names(spark, sf_dir))


def duplicate_groups(spark, sf_dir):
    full = _names(spark, sf_dir)
    return on.duplicate_groups(full.union(full.selectExpr("session_id", "split_part(name, ' ', 2)")).union(full.selectExpr("session_id", "substr(name, 1, 3)")).union(full.selectExpr("session_id", "'Dr ' || split_part(name, ' ', 1)")).distinct())


def normalize_dates(spark, sf_dir):
    return dates.with_normal_dates(notes(spark, sf_dir)).select("doc_id", "normalized")


def chunk_overlap(spark, sf_dir):
    return sg.chunks(_documents(spark, sf_dir)).select("doc_id", "chunk_no", "global_offset", "overlap_before", "overlap_after", F.md5(F.col("text").cast("binary")).alias("digest"))


def model_windows(spark, sf_dir):
    return sg.model_windows(_documents(spark, sf_dir))


def paragraph_pack(spark, sf_dir):
    out = _documents(spark, sf_dir).select("doc_id", F.posexplode(sg.packed(F.split("text", "\n"), 3000)).alias("pack_no", "x"))
    return out.select("doc_id", "pack_no", "x.*")


def line_numbering(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("line_no"), F.concat(F.lit("["), (F.col("i") + 1).cast("string"), F.lit("] "), "x").alias("line"))


_LABEL = "case length(word) % 5 when 0 then 'B-PER' when 1 then 'I-PER' when 2 then 'O' when 3 then 'I-LOC' else 'B-LOC' end"


def bio_islands(spark, sf_dir):
    tokens = notes(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("tok", "word")).selectExpr("doc_id", "tok", f"{_LABEL} as label")
    return sg.label_runs(tokens)


def argmax_labels(spark, sf_dir):
    first = F.slice("embedding", 1, 9)
    return read_table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position(first, F.array_max(first)) - 1).cast("long").alias("label_id"))


def bridge_gaps(spark, sf_dir):
    docs = notes(spark, sf_dir)
    return sg.bridged(mentions(docs, (BY_NAME["known_name"],)), docs)


def chunk_dedup(spark, sf_dir):
    from sealgrove.operators.recognizers import detect

    return detect(notes(spark, sf_dir), RULES).select("doc_id", F.explode(sp.without_chunk_overlaps(F.col("mentions"))).alias("x")).select("doc_id", "x.s", "x.e")


def conversation_last_n(spark, sf_dir):
    return sg.last_turns(read_table(spark, sf_dir, "conversations"), 3, 4).select("conv_id", "turn", "role", F.length("text").alias("chars"))


def recent_history(spark, sf_dir):
    """The last six turns of each conversation, rendered."""
    last = sg.last_turns(read_table(spark, sf_dir, "conversations"), 6, 0)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


def line_diff(spark, sf_dir):
    """Lines of each document that its source's next document doesn't have."""
    docs = _documents(spark, sf_dir)
    return sg.changed_lines(docs.select((F.col("doc_id") - 20).alias("id"), "text"), docs.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


ANSWERS = "case conv_id % 3 when 0 then '[CONVERSATION] ' || text when 1 then text || ' [REVIEW] ' || role || ' ' else text end"


def response_routing(spark, sf_dir):
    out = sg.routed(read_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{ANSWERS} as text"))
    return out.select("conv_id", "turn", "chat", "document", "review")


JSON = """case doc_id % 3 when 0 then 'Here: ' else '' end || '{"entities": [{"original": "' || person || '", "replacement": "[CLIENT_A]", "type": "' || case doc_id % 4 when 0 then 'client_name' when 1 then ' Patient' when 2 then 'place' else 'colour' end || '", "positions": [[1, ' || cast(doc_id % 50 + 2 as string) || '], [70, 80]]}, {"original": "", "replacement": "[X_A]", "type": "date", "positions": []}, {"original": "' || session_id || '", "replacement": "[ID_A]", "type": "id", "positions": []}]}' || case doc_id % 3 when 0 then ' done.' else '' end"""


def parse_model_json(spark, sf_dir):
    return sg.parse_answers(notes(spark, sf_dir).selectExpr("doc_id", f"{JSON} as json"))


FINDINGS = "'NAME|' || person || '|a name' || chr(10) || 'EMAIL | a' || session_id || '@b.nz' || chr(10) || 'TITLE|Doctor|job' || chr(10) || case when doc_id % 2 = 0 then '1. **' || person || '**|exact text|x' else 'Phone numbers found:' end || chr(10) || '- 021 555 ' || session_id || ' (a number)' || chr(10) || '- [PERSON_A] hidden' || chr(10) || 'DATE|[DATE_A]|gone'"


def parse_findings(spark, sf_dir):
    return sg.parse_findings(notes(spark, sf_dir).selectExpr("doc_id", f"{FINDINGS} as text"))


QUERIES = {
    f.__name__: f for f in (
        name_parse, variant_detect, mapping_expand_variants, capitalised_tokens, fuzzy_names, non_dictionary_words, known_surname_extend, occurrence_scan, duplicate_groups, normalize_dates,
        chunk_overlap, model_windows, paragraph_pack, line_numbering, bio_islands, argmax_labels, bridge_gaps, chunk_dedup, conversation_last_n, recent_history, line_diff, response_routing,
        parse_model_json, parse_findings)
}

_EXCLUDED = ", ".join(map(_quote, on.EXCLUDED))
_WORDS = f"""words as (select session_id, word, count(*) as n from (select session_id, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as word from notes)
  where regexp_full_match(word, '[A-Z][a-z]{{3,}}') and lower(word) not in ({_EXCLUDED}) group by all),
  people as (select distinct session_id, person as name from notes), parts as (select distinct session_id, unnest(string_split(name, ' ')) as name from people)"""
_SPAN = "struct(s int, l int, e int)"
_FOUND = " union all ".join(sql_scan("notes", r) for r in RULES)
_GOAL = "substr(text, pos + 7501, 500)"
_CUT = lambda s: f"case when instr(reverse({_GOAL}), reverse({s})) > 0 then pos + 7500 + 500 - instr(reverse({_GOAL}), reverse({s})) + 1 end"
ORACLES = {
    "name_parse": f"""{_WITH} select doc_id, name, case when doc_id % 4 = 0 then 'Mr' when doc_id % 4 = 3 then 'Prof' end as title,
        case when doc_id % 4 = 2 then split_part(person, ' ', 2) else split_part(person, ' ', 1) end as first, split_part(person, ' ', 2) as last, case when doc_id % 4 = 1 then 'Michael' end as middle
      from (select *, {NAME} as name from notes)""",
    "variant_detect": f"""{_WITH} select doc_id, alias, case doc_id % 9 when 0 then 'FULL' when 1 then 'FIRST_LAST' when 2 then 'FIRST' when 3 then 'LAST' when 4 then 'MIDDLE' when 5 then 'FORMAL' when 6 then 'FIRST_MID' when 7 then 'FIRST' end as variant
      from (select *, {ALIAS} as alias from (select doc_id, split_part(person, ' ', 1) as f, split_part(person, ' ', 2) as l from notes))""",
    "mapping_expand_variants": f"""{_WITH}, p as (select distinct session_id, person as name, split_part(person, ' ', 1) as f, split_part(person, ' ', 2) as l from notes)
      select session_id, name, unnest(['FULL', 'FIRST_LAST', 'FIRST', 'LAST', 'MIDDLE', 'FORMAL', 'FIRST_MID']) as variant, unnest([name, name, f, l, f, 'Mr ' || l, f]) as text from p""",
    "capitalised_tokens": "select doc_id, len(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{3,}'))) as n from documents",
    "fuzzy_names": f"""{_WITH}, {_WORDS}, pairs as (select w.session_id, word, name, levenshtein(lower(word), lower(name)) as d, case when length(name) >= 6 then 2 else 1 end as most from words w join parts p using (session_id) where length(name) >= 4),
      best as (select session_id, word, min({{'d': d, 'n': name}}) as m from pairs where d > 0 and d <= most group by 1, 2) select session_id, word, m.d::int as distance, m.n as name from best""",
    "non_dictionary_words": f"""{_WITH}, {_WORDS}, dict as (select distinct unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as word from documents)
      select session_id, word, n from words w where not exists (from parts p where p.session_id = w.session_id and lower(p.name) = lower(w.word)) and lower(word) not in (select word from dict)""",
    "known_surname_extend": f"""{_WITH}, pairs as (select session_id, doc_id, s, e, text from ({sql_scan("notes", BY_NAME["double_capital"].__class__("pair", 0, 0, r"\b[A-Z][a-z]+ +[A-Z][a-z]+\b", "person_other", 1.0), keys="session_id, doc_id")}))
      select doc_id, s, e, text from pairs p where exists (from notes n where n.session_id = p.session_id and split_part(n.person, ' ', 2) = regexp_extract(p.text, '([A-Z][a-z]+)$', 1))""",
    "occurrence_scan": f"""{_WITH}, {_WORDS}, names as (select distinct session_id, lower(name) as part from parts where length(name) >= 3 and lower(name) not in ({_EXCLUDED})),
      tokens as (select session_id, doc_id, s, e, text, lower(text) as l from ({sql_scan("notes", BY_NAME["double_capital"].__class__("word", 0, 0, "[A-Za-z]+", "person_other", 1.0), keys="session_id, doc_id")}))
      select doc_id, s, e, text, coalesce(a.part, b.part) as part from tokens t left join names a on t.session_id = a.session_id and t.l = a.part
      left join names b on t.session_id = b.session_id and a.part is null and t.l = b.part || 's' where a.part is not null or b.part is not null""",
    "duplicate_groups": f"""{_WITH}, people as (select distinct session_id, person as name from notes),
      names as (select * from people union select session_id, split_part(name, ' ', 2) from people union select session_id, substr(name, 1, 3) from people union select session_id, 'Dr ' || split_part(name, ' ', 1) from people),
      bare as (select *, lower(regexp_replace(name, '^Dr ', '')) as b from names), singles as (select * from bare where b not like '% %'), met as (select f.session_id, f.name as p, s.name as m from bare f join singles s on f.session_id = s.session_id and f.b like '% %' and list_contains(string_split(f.b, ' '), s.b))
      select session_id, p as primary_name, m as match_name, case when count(*) over (partition by session_id, m) > 1 then 'low' else 'high' end as confidence from met
      union all select a.session_id, a.name, b.name, 'low' from singles a join singles b on a.session_id = b.session_id and a.b <> b.b and starts_with(a.b, b.b) and length(b.b) >= 3""",
    "normalize_dates": f"select o_orderkey as doc_id, case when o_orderkey % 6 = 1 then text else replace(text, date, {_TWO(_D)} || '/' || {_TWO(_M)} || '/' || {_Y}) end as normalized from (select o.*, n.text, {DATE} as date from orders o join ({NOTES}) n on n.doc_id = o.o_orderkey)",
    "chunk_overlap": f"""with recursive c(doc_id, text, no, pos, stop) as (
        select doc_id, text, -1, 0, 0 from documents
        union all select doc_id, text, no + 1, stop, case when length(text) <= 8000 or stop + 8000 >= length(text) then length(text) else (select coalesce({_CUT("'. '")}, {_CUT("chr(10) || chr(10)")}, {_CUT("chr(10)")}, pos + 8000) from (select c.stop as pos, c.text as text)) end
        from c where stop < length(text) or (no = -1 and length(text) = 0)),
      k as (select *, greatest(0, pos - 200) as o, least(length(text), stop + 200) as z from c where no >= 0)
      select doc_id, no as chunk_no, o::int as global_offset, (pos - o)::int as overlap_before, (z - stop)::int as overlap_after, md5(substr(text, o + 1, z - o)) as digest from k""",
    "model_windows": """with w as (select doc_id, text, length(text) as n, unnest(range(0, case when length(text) <= 2000 then 1 else greatest(0, (length(text) - 101) // 1800) + 1 end)) as k from documents),
      x as (select *, substr(text, k * 1800 + 1801, 200) as shared from w)
      select doc_id, k::int as chunk_no, (k * 1800)::int as s, (case when k * 1800 + 2000 >= n then n else k * 1800 + case when contains(shared, '. ') then 2001 - instr(reverse(shared), ' .')
        when contains(shared, chr(10)) then 2001 - instr(reverse(shared), chr(10)) else 2000 end end)::int as e from x""",
    "paragraph_pack": """with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: {'n': length(x)::int, 'k': 1::int, 'o': []::struct(pieces int, chars int)[]}) as x from documents),
      f as (select doc_id, list_reduce(x, lambda a, b: case when a.n + 2 + b.n <= 3000 then {'n': (a.n + 2 + b.n)::int, 'k': (a.k + 1)::int, 'o': a.o} else {'n': b.n, 'k': 1::int, 'o': list_append(a.o, {'pieces': a.k, 'chars': a.n})} end) as r from l)
      select doc_id, (generate_subscripts(list_append(r.o, {'pieces': r.k, 'chars': r.n}), 1) - 1)::int as pack_no, unnest(list_append(r.o, {'pieces': r.k, 'chars': r.n}), recursive := true) from f""",
    "line_numbering": "select doc_id, i::int as line_no, '[' || i || '] ' || x as line from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)",
    "bio_islands": f"""{_WITH}, t as (select doc_id, tok, {_LABEL} as label from (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as tok from notes)),
      k as (select *, case when label = 'O' then '' else substr(label, 3) end as kind, count(*) filter (where label = 'O') over (partition by doc_id order by tok) as part from t),
      o as (select *, count(*) filter (where label like 'B-%') over (partition by doc_id, part order by tok) as open from k where kind <> ''),
      n as (select *, case when label like 'B-%' or lag(kind) over (partition by doc_id, part order by tok) is distinct from kind then 1 else 0 end as new from o where open > 0),
      g as (select *, sum(new) over (partition by doc_id, part order by tok) as span from n)
      select doc_id, kind as type, min(tok)::int as first_tok, max(tok)::int as last_tok from g group by doc_id, part, span, kind""",
    "argmax_labels": "select vec_id, (list_position(embedding[1:9], list_max(embedding[1:9])) - 1)::bigint as label_id from embeddings",
    "bridge_gaps": f"""{_WITH}, m as (select m.*, n.text as whole, lag(m.e) over (partition by doc_id order by m.s) as prev from ({sql_scan("notes", BY_NAME["known_name"])}) m join notes n using (doc_id)),
      f as (select *, case when s - prev between 1 and 29 and len(list_filter(regexp_split_to_array(substr(whole, prev + 1, s - prev), '\\s+'), lambda x: x <> '' and not regexp_matches(x, '^[A-Z].+'))) = 0 then 0 else 1 end as new from m),
      g as (select *, sum(new) over (partition by doc_id order by s) as run from f) select doc_id, min(s)::int as s, max(e)::int as e, min(confidence) as confidence, count(*) as n from g group by doc_id, run""",
    "chunk_dedup": f"""{_WITH}, l as (select doc_id, list({{'end': 0, 'x': {{'s': s, 'l': s - e, 'e': e}}, 'o': []::{_SPAN}[]}} order by s, s - e, e) as x from ({_FOUND}) group by doc_id),
      f as (select doc_id, list_reduce(x, lambda a, b: case when a."end" - b.x.s > (b.x.e - b.x.s) // 2 then a else {{'end': greatest(a."end", b.x.e), 'x': b.x, 'o': list_append(a.o, b.x)}} end, {{'end': 0, 'x': {{'s': 0, 'l': 0, 'e': 0}}, 'o': []::{_SPAN}[]}}) as r from l)
      select doc_id, u.s, u.e from (select doc_id, unnest(r.o) as u from f)""",
    "conversation_last_n": "select conv_id, turn, role, length(text)::int as chars from (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as k from conversations) where n <= 4 or k <= 3",
    "recent_history": "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as history from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 6 group by conv_id",
    "line_diff": """with lines as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
      n as (select doc_id, i, regexp_replace(trim(x, ' ' || chr(9)), '\\s+', ' ', 'g') as x from lines)
      select a.doc_id, a.i::int as line_no from n a where x <> '' and not exists (from n b where b.doc_id = a.doc_id + 20 and b.x = a.x)""",
    "response_routing": f"""select conv_id, turn, case when conv_id % 3 = 0 then regexp_replace(substr(t, 15), '^\\s+|\\s+$', '', 'g') end as chat,
        case when conv_id % 3 = 1 then regexp_replace(substr(t, 1, instr(t, '[REVIEW]') - 1), '^\\s+|\\s+$', '', 'g') when conv_id % 3 = 2 then t end as document,
        case when conv_id % 3 = 1 then regexp_replace(substr(t, instr(t, '[REVIEW]') + 8), '^\\s+|\\s+$', '', 'g') end as review from (select *, {ANSWERS} as t from conversations)""",
    "parse_model_json": f"""{_WITH} select doc_id, person as original, '[CLIENT_A]' as replacement, case doc_id % 4 when 2 then 'location' else 'person_client' end as type, unnest([1, 70])::int as s, unnest([doc_id % 50 + 2, 80])::int as e from notes where doc_id % 4 <> 3
      union all select doc_id, session_id, '[ID_A]', 'identifier', 0, 0 from notes""",
    "parse_findings": f"""{_WITH} select doc_id, 0 as line_no, person as finding, 'person_other' as type, 'a name' as reason from notes union all select doc_id, 1, 'a' || session_id || '@b.nz', 'contact', 'Potential PII detected' from notes
      union all select doc_id, 4, '021 555 ' || session_id, 'contact', 'a number' from notes""",
}
