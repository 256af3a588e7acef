"""Queries on parts of documents, replacement by text, lists in and out, streams; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealgrove.operators import entities as e
from sealgrove.operators import files as fl
from sealgrove.operators import parts as pt
from sealgrove.operators import segments as sg
from sealgrove.operators.recognizers import BY_NAME, mentions
from sealgrove.plans.detection import sql_scan
from sealgrove.plans.entities import _PREFIX, ON_NOTES, RULES, _coded, _found, _redacted
from sealgrove.plans.notes import notes
from sealgrove.sources.tables import read_table, spread, written

ANSWER = """case doc_id % 5 when 0 then 'no json' when 1 then '{"documents": [{"title": "One", "startLine": 3}]}'
  when 2 then 'Sure: {"documents": [{"title": "A", "author": "X", "startLine": 1, "endLine": 2}, {"date": "May", "startLine": 3, "endLine": 3, "type": "Letter"}]} done'
  when 3 then '{"documents": [{"startLine": 90000, "endLine": 90001}, {"startLine": 2}]}' else '{"documents": [{"startLine": 2, "endLine": 1}, {}, {"summary": "s", "startLine": 1}]}' end"""
LIST = "case doc_id % 4 when 0 then ' Word' || cast(doc_id % 20 as string) || ' , date' when 1 then 'WORD' || cast(doc_id % 20 as string) || ',colour,more' when 2 then 'word' || cast(doc_id % 20 as string) else ' ,date' end"


def _documents(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def sub_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    out = pt.sub_documents(docs, docs.selectExpr("doc_id", f"{ANSWER} as json"))
    return out.select("doc_id", "id", "title", "author", "date", "type", "summary", F.md5(F.col("content").cast("binary")).alias("digest"))


def boundary_windows(spark, sf_dir):
    return pt.boundary_windows(_documents(spark, sf_dir), window=300, overlap=100)


def window_sub_documents(spark, sf_dir):
    """Sub-documents that neighbouring windows both found."""
    w = pt.boundary_windows(_documents(spark, sf_dir), window=300, overlap=100)
    found = w.select("doc_id", "window_no", F.inline(F.expr(
        "array(named_struct('f', first_line, 't', 'Letter', 'a', 'A'), named_struct('f', last_line, 't', 'Note', 'a', 'B'), named_struct('f', cast(null as int), 't', 'Note', 'a', 'C'))"
    )).alias("first_line", "title", "author"))
    return pt.distinct_sub_documents(found)


def chunk_positions(spark, sf_dir):
    """Numbers found chunk by chunk, as spans of their documents."""
    chunks = written(sg.chunks(_documents(spark, sf_dir), size=2000), "chunks")
    return pt.chunk_positions(mentions(chunks, (BY_NAME["numbers_joined"],), keys=("doc_id", "chunk_no")), chunks)


def _entities(own):
    return own.select("doc_id", "text", "type", "code").distinct()


def redact_by_text(spark, sf_dir):
    """Notes with every occurrence of their entities' texts replaced."""
    own, codes = _coded(spark, sf_dir)
    typed = own.join(codes.select(F.col("session_id").alias("_s"), F.col("key").alias("_k"), "type"), F.expr("session_id <=> _s and key = _k")).drop("_s", "_k") if "type" not in own.columns else own
    return pt.redact_by_text(notes(spark, sf_dir).select("doc_id", "text"), _entities(typed)).select("doc_id", "redacted")


def verify_replacement(spark, sf_dir):
    """Whether all codes are in texts of which some have lost one."""
    red, own, _ = _redacted(spark, sf_dir)
    return pt.verified(red.withColumn("redacted", F.replace("redacted", F.lit("[ID_A]"), F.lit("[ID]"))), own)


def put_back(spark, sf_dir):
    red, _, codes = _redacted(spark, sf_dir)
    return pt.put_back(red, e.mapping(codes)).select("doc_id", "restored")


def word_list(spark, sf_dir):
    """A word list read from lines, and written."""
    lines = read_table(spark, sf_dir, "documents").selectExpr("doc_id as line_no", f"{LIST} as line")
    return pt.csv_of_words(pt.words_of_csv(lines))


def excluded_words(spark, sf_dir):
    lists = read_table(spark, sf_dir, "documents").selectExpr("concat('a', doc_id % 7, ' ,, b', doc_id % 3, ',A') as line")
    return pt.excluded_of_csv(lists)


def mapping_roundtrip(spark, sf_dir):
    """Mappings written as JSON and read back."""
    return pt.mapping_of_json(pt.mapping_json(_coded(spark, sf_dir)[1]))


def mentioned_entities(spark, sf_dir):
    """Entities of sessions whose code is in the session's first note."""
    red, own, _ = _redacted(spark, sf_dir)
    first = red.groupBy("session_id").agg(F.min_by("redacted", "doc_id").alias("output"))
    return pt.mentioned(own.select("session_id", "doc_seq", "text", "code"), first)


def sources_with_parts(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    parts = docs.select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") - F.col("doc_id") % 3).alias("doc_id"))
    return pt.sources_with_parts(docs, parts)


def entity_at(spark, sf_dir):
    """The mention at some positions of each note."""
    at = notes(spark, sf_dir).select("doc_id", F.explode(F.array((F.col("doc_id") % 90).cast("int"), F.lit(8))).alias("at")).distinct()
    return pt.mention_at(_found(spark, sf_dir), at)


def highlight_spans(spark, sf_dir):
    """What is marked in notes and in their redacted texts."""
    own, _ = _coded(spark, sf_dir)
    out = e.output_offsets(own).select("doc_id", F.lit("redacted").alias("side"), F.col("out_s").alias("s"), F.col("out_e").alias("e"))
    return own.select("doc_id", F.lit("original").alias("side"), "s", "e").unionByName(out)


COMMAND = "case doc_id % 7 when 0 then 'create' when 1 then 'str_replace' when 2 then 'insert' when 3 then 'delete' when 4 then 'rename' when 5 then 'str_replace' end"
FILE = "'f' || doc_id % 5 || '/d' || doc_id || '.md'"


def _files(spark, sf_dir):
    return _documents(spark, sf_dir).selectExpr("doc_id", f"{FILE} as path", "text")


def _commands(spark, sf_dir):
    """A command for most files; those of every fourth are on files that aren't there."""
    path = f"'/memories/' || case when doc_id % 4 = 0 then 'none' else '' end || {FILE}"
    a = "case doc_id % 7 when 1 then 'zzz' when 4 then 'moved/d' || doc_id when 5 then 'e' else 'one line' end"
    return _files(spark, sf_dir).filter("doc_id % 7 < 6").selectExpr(f"{COMMAND} as command", f"{path} as path", f"{a} as a", "'X' as b", "cast(case when doc_id % 3 = 0 then 99999 else 1 end as int) as line")


def file_answers(spark, sf_dir):
    """What commands on memory files answer."""
    return fl.commanded(_files(spark, sf_dir).select("path", "text"), _commands(spark, sf_dir))[1]


def file_commands(spark, sf_dir):
    """Memory files after the commands."""
    out = fl.commanded(_files(spark, sf_dir).select("path", "text"), _commands(spark, sf_dir))[0]
    return out.select("path", F.md5(F.col("text").cast("binary")).alias("digest"))


def file_views(spark, sf_dir):
    """Views of memory files: all, a range, to the end, and of files that aren't there."""
    files = _files(spark, sf_dir)
    ranges = "case when doc_id % 3 > 0 then 2 end as first", "case doc_id % 3 when 1 then 3 when 2 then -1 end as last"
    views = files.selectExpr(f"case when doc_id % 10 = 0 then 'no/' else '/memories/' end || {FILE} as path", *ranges)
    return fl.viewed(files.select("path", "text"), views)


def _arriving(spark, sf_dir):
    from sealgrove.plans.notes import COLUMNS

    path = f"{sf_dir.rstrip('/')}/orders.parque[t]"  # a pattern, as a stream's path may not be a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).selectExpr(*(f"{x} as {c}" for c, x in COLUMNS.items()))


def stream_redact(spark, sf_dir):
    """Notes that arrive as a stream, redacted with their sessions' codes."""
    from sealgrove.streaming.redaction import finished, redact_stream

    return finished(redact_stream(_arriving(spark, sf_dir), RULES)).select("doc_id", "redacted")


def stream_mask(spark, sf_dir):
    """Notes that arrive as a stream, with types in place of what is found; no state."""
    from sealgrove.streaming.redaction import finished, mask_stream

    return finished(mask_stream(_arriving(spark, sf_dir), RULES).select("doc_id", "masked"))


QUERIES = {f.__name__: f for f in (
    sub_documents, boundary_windows, window_sub_documents, chunk_positions, redact_by_text, verify_replacement, put_back, word_list, excluded_words, mapping_roundtrip, mentioned_entities,
    sources_with_parts, entity_at, highlight_spans, file_answers, file_commands, file_views, stream_redact, stream_mask)}
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_LINES = "array_to_string(l[{}:{}], chr(10))"
_PIECE = "substr(text, {i} * (length(text) // {n}) + 1, length(text) // {n})"
_SUB = f"""with d as (select doc_id, text, string_split(text, chr(10)) as l from documents), p as (
    select doc_id, 'doc1' as id, case doc_id % 5 when 0 then 'Document' else 'One' end as title, null as author, null as date, 'Unknown' as type, '' as summary, text as content from d where doc_id % 5 < 2
    union all select doc_id, 'doc_0', 'A', 'X', null, 'Unknown', '', {_TRIM.format(_LINES.format(1, 2))} from d where doc_id % 5 = 2
    union all select doc_id, 'doc_1', 'Document 2', null, 'May', 'Letter', '', {_TRIM.format('case when len(l) >= 3 then ' + _LINES.format(3, 'len(l)') + ' else ' + _PIECE.format(i=1, n=2) + ' end')} from d where doc_id % 5 = 2
    union all select doc_id, 'doc_0', 'Document 1', null, null, 'Unknown', '', {_TRIM.format(_PIECE.format(i=0, n=2))} from d where doc_id % 5 = 3
    union all select doc_id, 'doc_1', 'Document 2', null, null, 'Unknown', '', {_TRIM.format('case when len(l) >= 2 then ' + _LINES.format(2, 'len(l)') + ' else ' + _PIECE.format(i=1, n=2) + ' end')} from d where doc_id % 5 = 3
    union all select doc_id, 'doc_0', 'Document 1', null, null, 'Unknown', '', {_TRIM.format(_PIECE.format(i=0, n=3))} from d where doc_id % 5 = 4
    union all select doc_id, 'doc_' || i, 'Document ' || (i + 1), null, null, 'Unknown', case i when 2 then 's' else '' end, {_TRIM.format('text')} from d, (values (1), (2)) v(i) where doc_id % 5 = 4)
  select doc_id, id, title, author, date, type, summary, md5(content) as digest from p"""
_WINDOWS = """w as (select doc_id, k::int as window_no, (k * 2 + 1)::int as first_line, least(n, k * 2 + 3)::int as last_line
    from (select doc_id, n, unnest(range(0, greatest(0, ceil((n - 3) / 2))::int + 1)) as k from (select doc_id, len(string_split(text, chr(10))) as n from documents)))"""
ORACLES = {
    "sub_documents": _SUB,
    "boundary_windows": f"with {_WINDOWS} select * from w",
    "window_sub_documents": f"""with {_WINDOWS}, f as (select doc_id, window_no, first_line, 'Letter' as title, 'A' as author from w union all select doc_id, window_no, last_line, 'Note', 'B' from w),
      r as (select *, row_number() over (partition by doc_id, first_line order by window_no, title, author) as k from f)
      select doc_id, first_line, title, author from r where k = 1 union all select distinct doc_id, null, 'Note', 'C' from w""",
    "chunk_positions": f"select doc_id, s, e, text from ({sql_scan('documents', BY_NAME['numbers_joined'])})",
    "verify_replacement": ON_NOTES + "select doc_id, bool_and(contains(replace(redacted, '[ID_A]', '[ID]'), code)) as is_complete from coded join redacted using (doc_id) group by doc_id",
    "put_back": ON_NOTES + """select t.doc_id, coalesce(x, t.text) as restored from notes t left join (select doc_id, string_agg(gap || original || substr(shown, length(code) + 1), '' order by s)
      || substr(any_value(whole), max(e) + 1) as x from pieces group by doc_id) using (doc_id)""",
    "word_list": f"""with l as (select doc_id, string_split({LIST}, ',') as p from documents), w as (select doc_id, trim(p[1]) as word, case when trim(p[2]) = 'date' then 'date' else 'person_other' end as type from l),
      r as (select *, row_number() over (partition by lower(word) order by doc_id desc) as k from w where word <> '') select word || ',' || type as line from r where k = 1""",
    "excluded_words": "select distinct unnest(['a' || doc_id % 7, 'b' || doc_id % 3, 'A']) as word from documents",
    "mapping_roundtrip": ON_NOTES + "select session_id, key, original, code from codes",
    "mentioned_entities": ON_NOTES + """, out as (select session_id, arg_min(redacted, doc_id) as output from redacted group by session_id)
      select session_id, lower(text) as key, arg_min(text, {'d': doc_seq, 't': text, 'c': code}) as text, arg_min(code, {'d': doc_seq, 't': text, 'c': code}) as code
      from (select c.*, n.doc_seq from coded c join notes n using (doc_id)) x where exists (from out o where o.session_id = x.session_id and contains(output, code)) group by 1, 2""",
    "sources_with_parts": """with p as (select case when doc_id % 3 > 0 then doc_id - doc_id % 3 end as doc_id from documents)
      select d.doc_id, count(p.doc_id) as n_parts from documents d left join p using (doc_id) group by 1 union all select null, count(*) from p where doc_id is null having count(*) > 0""",
    "entity_at": ON_NOTES + """, a as (select distinct doc_id, unnest([doc_id % 90, 8])::int as at_place from notes)
      select a.doc_id, at_place as at, k.text from a left join kept k on k.doc_id = a.doc_id and k.s <= at_place and at_place < k.e""",
    "highlight_spans": ON_NOTES + """select doc_id, 'original' as side, s, e from coded union all
      select doc_id, 'redacted', (s + d)::int, (s + d + length(shown))::int from (select *, coalesce(sum(length(shown) - (e - s)) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding), 0) as d from coded)""",
    "file_answers": f"""with c as (select *, {COMMAND} as command, '/memories/' || case when doc_id % 4 = 0 then 'none' else '' end || {FILE} as path, doc_id % 4 = 0 as gone, string_split(text, chr(10)) as l from documents where doc_id % 7 < 6)
      select command, path, case command when 'create' then case when gone then 'File created successfully at: ' || path else 'Error: File ' || path || ' already exists' end
        when 'str_replace' then case when gone then 'Error: The path ' || path || ' does not exist. Please provide a valid path.'
          when doc_id % 7 = 1 and not contains(text, 'zzz') then 'No replacement was performed, old_str `zzz` did not appear verbatim in ' || path || '.'
          when doc_id % 7 = 1 then 'The memory file has been edited.' when not contains(text, 'e') then 'No replacement was performed, old_str `e` did not appear verbatim in ' || path || '.'
          when length(text) - length(replace(text, 'e', '')) = 1 then 'The memory file has been edited.'
          else 'No replacement was performed. Multiple occurrences of old_str `e` in lines: ' || array_to_string(list_filter(range(1, len(l) + 1), lambda i: contains(l[i], 'e')), ', ') || '. Please ensure it is unique' end
        when 'insert' then case when gone then 'Error: The path ' || path || ' does not exist' when doc_id % 3 = 0
          then 'Error: Invalid `insert_line` parameter: 99999. It should be within the range of lines of the file: [0, ' || len(l) || ']' else 'The file ' || path || ' has been edited.' end
        when 'delete' then case when gone then 'Error: The path ' || path || ' does not exist' else 'Successfully deleted ' || path end
        else case when gone then 'Error: The path ' || path || ' does not exist' else 'Successfully renamed ' || path || ' to moved/d' || doc_id end end as answer from c""",
    "file_commands": f"""select {FILE} as path, md5(text) as digest from documents where doc_id % 4 = 0 or doc_id % 7 in (0, 6) or (doc_id % 7 = 1 and length(text) - length(replace(text, 'zzz', '')) <> 3)
          or (doc_id % 7 = 5 and length(text) - length(replace(text, 'e', '')) <> 1) or (doc_id % 7 = 2 and doc_id % 3 = 0)
      union all select {FILE}, md5(replace(replace(text, case when doc_id % 7 = 5 then 'e' else 'zzz' end, 'X'), '', '')) from documents where doc_id % 4 > 0
        and (doc_id % 7 = 5 and length(text) - length(replace(text, 'e', '')) = 1 or doc_id % 7 = 1 and length(text) - length(replace(text, 'zzz', '')) = 3)
      union all select 'none' || {FILE}, md5('one line') from documents where doc_id % 28 = 0
      union all select {FILE}, md5(split_part(text, chr(10), 1) || chr(10) || 'one line' || substr(text, length(split_part(text, chr(10), 1)) + 1)) from documents where doc_id % 7 = 2 and doc_id % 4 > 0 and doc_id % 3 > 0
      union all select 'moved/d' || doc_id, md5(text) from documents where doc_id % 7 = 4 and doc_id % 4 > 0""",
    "file_views": f"""with v as (select doc_id, case when doc_id % 10 = 0 then 'no/' else '/memories/' end || {FILE} as path, string_split(text, chr(10)) as l from documents),
      r as (select *, len(l) as n, case when doc_id % 3 > 0 then 1 else 0 end as b, case doc_id % 3 when 0 then least(len(l), 300) when 1 then case when least(3, len(l)) < 1 then len(l) else least(3, len(l)) end else len(l) end as z from v)
      select path, case when doc_id % 10 = 0 then 'The path ' || path || ' does not exist. Please provide a valid path.'
        else case when doc_id % 3 = 0 and n > 300 then 'Here''s the first 300 lines of ' || path || ' (total: ' || n || ' lines):' || chr(10) else 'Here''s the content of ' || path || ' with line numbers:' || chr(10) end
          || array_to_string(list_transform(range(b + 1, z + 1), lambda i: lpad(i::varchar, 6, ' ') || chr(9) || l[i] || chr(10)), '')
          || case when doc_id % 3 = 0 and n > 300 then chr(10) || '[... ' || (n - 300) || ' more lines. Use view_range: [start, end] to see specific sections ...]' || chr(10) else '' end end as answer from r""",
    "stream_mask": ON_NOTES + f"""select doc_id, coalesce(masked, text) as masked from notes left join (
      select doc_id, string_agg(gap || '[' || {_PREFIX} || ']', '' order by s) || substr(any_value(whole), max(e) + 1) as masked from pieces group by doc_id) using (doc_id)""",
    "stream_redact": ON_NOTES + "select doc_id, redacted from redacted",
}
