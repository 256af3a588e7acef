"""Queries on edits of codes and word lists, over the codes of notes, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sealgrove.operators import edits as ed
from sealgrove.operators.edit_log import chained, counters, replayed
from sealgrove.plans.entities import ON_NOTES, _coded, _letters_sql
from sealgrove.plans.notes import notes
from sealgrove.sources.tables import read_table

COLUMNS = ("session_id", "key", "original", "code")
CODES = "session_id string, key string, original string, type string, code string, base_id string, variant string, anchor boolean"


def _codes(spark, sf_dir):
    return _coded(spark, sf_dir)[1]


def upsert_codes(spark, sf_dir):
    """Contacts are renamed, a new key comes in, and of the changes to known keys only those that are there count."""
    codes = _codes(spark, sf_dir)
    own = codes.filter("type = 'contact'").withColumn("original", F.upper("original"))
    new = codes.select("session_id").distinct().selectExpr("session_id", "'zzz' as key", "'Zzz' as original", "'contact' as type", "'[CONTACT_ZZ]' as code", "'CONTACT_ZZ' as base_id", "cast(null as string) as variant", "false as anchor")
    both = ed.upserted(codes, own.unionByName(new))
    return ed.upserted(both, new.withColumn("key", F.lit("yyy")), only_known=True).select(*COLUMNS)


def register_placeholders(spark, sf_dir):
    """Placeholders of an answer that a session doesn't know."""
    codes = _codes(spark, sf_dir)
    found = codes.select("session_id", F.explode(F.array(F.lit("[PERSON_A]"), F.lit("[DATE_QQQ]"), F.lit("[PERSON_QQ_FIRST]"))).alias("code")).distinct()
    return ed.with_unknown_placeholders(codes, found).filter("original = '' or code = '[PERSON_A]'").select(*COLUMNS)


def reclassify(spark, sf_dir):
    """Identifiers of every fifth session become organizations."""
    codes = _codes(spark, sf_dir)
    picks = codes.filter("type = 'identifier' and length(original) % 2 = 1").selectExpr("session_id", "key", "'organization' as new_type")
    return ed.reclassified_keys(codes, picks).filter("type in ('organization', 'identifier')").select(*COLUMNS)


def reclassify_groups(spark, sf_dir):
    """Persons with an anchor become clients, contacts A to C dates, whose letters are taken."""
    codes = _codes(spark, sf_dir)
    people = codes.filter("anchor").selectExpr("session_id", "base_id", "'person_client' as new_type")
    other = codes.filter("base_id in ('CONTACT_A', 'CONTACT_B', 'CONTACT_C')").selectExpr("session_id", "base_id", "'date' as new_type").distinct()
    return ed.reclassified_groups(codes, people.unionByName(other)).filter("type in ('date', 'person_client')").select(*COLUMNS)


def merge_alias(spark, sf_dir):
    """In each session the first single name becomes an alias of the second one, and a stranger of the first anchor."""
    codes = _codes(spark, sf_dir)
    single = codes.filter("type like 'person%' and variant is null").groupBy("session_id").agg(F.array_sort(F.collect_set("key")).alias("k")).filter("size(k) > 1")
    picks = single.select("session_id", F.col("k")[0].alias("alias"), F.col("k")[1].alias("primary"))
    anchors = codes.filter("anchor").groupBy("session_id").agg(F.min("key").alias("primary")).select("session_id", F.lit("jo bloggs").alias("alias"), "primary")
    return ed.merged_aliases(codes, picks.unionByName(anchors)).filter("type like 'person%'").select(*COLUMNS, "anchor")


def edit_name(spark, sf_dir):
    """Anchors get another name."""
    codes = _codes(spark, sf_dir)
    names = codes.filter("anchor").selectExpr("session_id", "base_id", "case when length(original) % 2 = 0 then 'Dr Ann Beth Cole' else 'Ann Cole' end as name")
    out = ed.renamed_persons(codes, names)
    return out.join(names.select(F.col("session_id").alias("_s"), F.col("base_id").alias("_b")), F.expr("session_id = _s and base_id = _b"), "left_semi").select("session_id", "base_id", "original", "variant")


def add_custom(spark, sf_dir):
    """Terms of the user's, of which some occur in a session's notes."""
    codes = _codes(spark, sf_dir)
    terms = codes.select("session_id").distinct().select("session_id", F.inline(F.expr("array((' Middlemore ', 'organization'), ('weighs', 'identifier'), ('nowhere to be', 'date'))")).alias("term", "type"))
    return ed.with_custom_terms(codes, notes(spark, sf_dir), terms).filter("key in ('middlemore', 'weighs', 'nowhere to be')").select(*COLUMNS)


def remove_group(spark, sf_dir):
    """The bases of anchors go, with all that hangs on them."""
    codes = _codes(spark, sf_dir)
    return ed.without_groups(codes, codes.filter("anchor").select("session_id", "key")).select(*COLUMNS)


def toggle_group(spark, sf_dir):
    """Keys that are excluded after persons' groups were toggled, with the states of groups."""
    codes = _codes(spark, sf_dir).filter("type like 'person%'")
    before = codes.filter("length(key) % 3 = 0").select("session_id", "key")
    after = ed.toggled_groups(codes, before, codes.filter("length(base_id) = 8").select("session_id", "base_id").distinct())
    return ed.group_states(codes, after)


def edit_words(spark, sf_dir):
    """A word list after edits: retyped, deleted and new words."""
    words = read_table(spark, sf_dir, "documents").selectExpr("'Word' || doc_id as word", "'person_other' as type")
    changes = read_table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").selectExpr("'WORD' || doc_id as word", "case when doc_id % 2 = 0 then 'date' else 'contact' end as type", "doc_id % 5 = 0 as gone", "doc_id as at")
    return ed.edited_words(words, changes)


def after_removal(spark, sf_dir):
    """Contacts go and others are reclassified as contacts: with the counters of before, no code is dealt a second time."""
    codes = _codes(spark, sf_dir)
    left = ed.removed(codes, codes.filter("type = 'contact' and length(original) % 2 = 0"))
    picks = left.filter("type = 'identifier'").selectExpr("session_id", "key", "'contact' as new_type")
    return ed.reclassified_keys(left, picks, counters(codes)).filter("type = 'contact'").select(*COLUMNS)


#: A log of edits by users, from events: sessions of users, eleven keys each, edits of all kinds.
LOG = {
    "session_id": "cast(user_id % 20 as string)", "at": "event_id",
    "kind": "case when event_id % 397 = 0 then 'clear' else split_part('add,add,add,reclassify,remove,merge,update,set,remove_group,add', ',', cast(event_id % 10 + 1 as int)) end",
    "key": "concat('k', cast(event_id * 7 % 11 as string))", "original": "concat('K', cast(event_id * 7 % 11 as string))",
    "type": "split_part('contact,identifier,date', ',', cast(event_id % 3 + 1 as int))",
    "code": "concat('[', split_part('CONTACT,ID,DATE', ',', cast(event_id % 3 + 1 as int)), '_ZZZ', chr(cast(65 + event_id % 26 as int)), ']')",
    "primary": "concat('k', cast(event_id * 3 % 11 as string))",
}


def edit_sequence(spark, sf_dir):
    """What the keys of each session have after the whole log."""
    log = read_table(spark, sf_dir, "events").selectExpr(*(f"{x} as `{name}`" for name, x in LOG.items()))
    return replayed(spark.createDataFrame([], CODES), log).select("session_id", "key", "base_id", "type")


def merge_chains(spark, sf_dir):
    """Orders' links to the next order of their customer, followed to the end; every customer of a seventh goes round in a circle."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    links = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.coalesce(after, F.when(F.col("o_custkey") % 7 == 0, first)).alias("next"))
    key = lambda x: F.lpad(F.col(x).cast("string"), 12, "0")
    return chained(links.select((F.col("o_custkey") % 50).cast("string").alias("session_id"), key("o_orderkey").alias("alias"), key("next").alias("primary")))


QUERIES = {
    f.__name__: f
    for f in (upsert_codes, register_placeholders, reclassify, reclassify_groups, merge_alias, edit_name, add_custom, remove_group, toggle_group, edit_words, after_removal, edit_sequence, merge_chains)
}


def _next(prefix: str, rank: str) -> str:
    """The code base of a prefix behind the highest in a session `p`."""
    index = "list_reduce(list_transform(string_split(split_part(t.base_id, '_', 2), ''), lambda x: ord(x) - 64), lambda a, b: a * 26 + b)"
    n = f"({rank} - 1 + coalesce((select max({index}) from codes t where t.session_id = p.session_id and split_part(t.base_id, '_', 1) = '{prefix}'), 0))"
    return f"'{prefix}_' || {_letters_sql(n)}"


_LETTERED = _letters_sql("n")
#: The log replayed edit by edit: the keys with their bases and types, and the next number of each prefix.
_SEQUENCE = f"""
with recursive log as (
  select *, row_number() over (partition by session_id order by "at") as i, split_part('CONTACT,ID,DATE', ',', list_position(['contact', 'identifier', 'date'], type)::int) as prefix
  from (select {', '.join(f'{x} as "{name}"' for name, x in LOG.items())} from events)),
replay as (
  select distinct session_id, 0::bigint as i, map([]::varchar[], []::struct(base varchar, type varchar)[]) as held, map([]::varchar[], []::bigint[]) as next from log
  union all
  select session_id, i, case
      when kind = 'clear' then map([]::varchar[], []::struct(base varchar, type varchar)[])
      when deals then map_concat(held, map([key], [{{'base': prefix || '_' || {_LETTERED}, 'type': type}}]))
      when kind = 'set' or kind = 'update' and has then map_concat(held, map([key], [coalesce(
        list_filter(map_entries(held), lambda x: x.value.base = trim(code, '[]') and x.key <> key)[1].value, {{'base': trim(code, '[]'), 'type': type}})]))
      when kind = 'remove' then map_from_entries(list_filter(map_entries(held), lambda x: x.key <> key))
      when kind = 'remove_group' and has then map_from_entries(list_filter(map_entries(held), lambda x: x.value.base <> held[key].base))
      when kind = 'merge' and map_contains(held, "primary") then map_concat(held, map([key], [held["primary"]]))
      else held end,
    case when kind = 'clear' then map([]::varchar[], []::bigint[]) when deals then map_concat(next, map([prefix], [n + 1])) else next end
  from (
    select l.*, held, next, map_contains(held, key) as has, kind = 'reclassify' or kind = 'add' and not map_contains(held, key) as deals, coalesce(next[prefix], 0) as n
    from replay r join log l on l.session_id = r.session_id and l.i = r.i + 1)),
ended as (select r.* from replay r join (select session_id, max(i) as i from log group by 1) using (session_id, i))
select session_id, e.key as key, e.value.base as base_id, e.value.type as type from (select session_id, unnest(map_entries(held)) as e from ended)"""
ORACLES = {
    "edit_sequence": _SEQUENCE,
    "merge_chains": """with links as (select *, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as next, max(o_orderkey) over (partition by o_custkey) as last, min(o_orderkey) over (partition by o_custkey) as first from orders)
      select (o_custkey % 50)::varchar as session_id, lpad(o_orderkey::varchar, 12, '0') as alias, lpad(case when o_custkey % 7 = 0 then first else last end::varchar, 12, '0') as primary
      from links where o_orderkey <> case when o_custkey % 7 = 0 then first else last end""",
    "after_removal": ON_NOTES + f"""select session_id, key, original, code from codes where type = 'contact' and length(original) % 2 = 1
      union all select session_id, key, original, '[' || {_next('CONTACT', 'rank')} || ']' from (select *, row_number() over (partition by session_id order by key) as rank from codes where type = 'identifier') p""",
    "upsert_codes": ON_NOTES + """select session_id, key, case when type = 'contact' then upper(original) else original end as original, code from codes
      union all select distinct session_id, 'zzz', 'Zzz', '[CONTACT_ZZ]' from codes""",
    "register_placeholders": ON_NOTES + """select session_id, key, original, code from codes where code = '[PERSON_A]'
      union all select distinct session_id, '[person_a]', '', '[PERSON_A]' from codes s where not exists (from codes t where t.session_id = s.session_id and t.code = '[PERSON_A]')
      union all select distinct session_id, lower(x), '', x from (select session_id, unnest(['[DATE_QQQ]', '[PERSON_QQ_FIRST]']) as x from codes)""",
    "reclassify": ON_NOTES + f"""select session_id, key, original, code from codes where type = 'identifier' and length(original) % 2 = 0 or type = 'organization'
      union all select session_id, key, original, '[' || {_next('ORG', 'rank')} || ']' from (select *, row_number() over (partition by session_id order by key) as rank
        from codes where type = 'identifier' and length(original) % 2 = 1) p""",
    "reclassify_groups": ON_NOTES + f"""select session_id, key, original, code from codes where type = 'date'
      union all select session_id, key, original, '[' || replace(base_id, 'PERSON', 'CLIENT') || coalesce('_' || variant, '') || ']' from codes k
        where exists (from codes a where a.anchor and a.session_id = k.session_id and a.base_id = k.base_id)
      union all select session_id, key, original, '[' || case when free then replace(base_id, 'CONTACT', 'DATE') else {_next('DATE', 'rank')} end || ']' from (
        select *, row_number() over (partition by session_id, free order by base_id) as rank from (
          select *, not exists (from codes t where t.session_id = k.session_id and t.base_id = replace(k.base_id, 'CONTACT', 'DATE')) as free
          from codes k where base_id in ('CONTACT_A', 'CONTACT_B', 'CONTACT_C'))) p""",
    "merge_alias": ON_NOTES + """, lone as (select *, row_number() over (partition by session_id order by key) as nth, count(*) over (partition by session_id) as many
        from codes where type like 'person%' and variant is null),
      two as (select a.session_id, a.key as alias, b.key as main, b.original, b.base_id from lone a join lone b on a.session_id = b.session_id and a.nth = 1 and b.nth = 2),
      anchor as (select session_id, min(key) as key from codes where anchor group by 1)
      select session_id, alias as key, original, '[' || base_id || '_FIRST]' as code, false as anchor from two
      union all select session_id, 'jo bloggs', first || ' ' || last, '[' || base_id || '_FIRST_LAST]', false from people p join anchor using (session_id, key)
      union all select k.session_id, k.key, k.original, case when t.main is not null then '[' || k.base_id || '_FIRST_LAST]' else k.code end, k.anchor or t.main is not null
        from codes k left join two t on k.session_id = t.session_id and k.key = t.main where type like 'person%'
          and not exists (from two x where x.session_id = k.session_id and x.alias = k.key)""",
    "edit_name": ON_NOTES + """select session_id, base_id, unnest(case when length(original) % 2 = 0 then ['Ann Beth Cole', 'Ann Cole', 'Ann', 'Cole', 'Beth', 'Dr Cole', 'Ann Beth'] else ['Ann Cole', 'Ann', 'Cole', 'Mr Cole'] end) as original,
      unnest(case when length(original) % 2 = 0 then ['FULL', 'FIRST_LAST', 'FIRST', 'LAST', 'MIDDLE', 'FORMAL', 'FIRST_MID'] else ['FIRST_LAST', 'FIRST', 'LAST', 'FORMAL'] end) as variant from codes where anchor""",
    "add_custom": ON_NOTES + f"""select session_id, 'middlemore' as key, 'Middlemore' as original, '[' || {_next('ORG', '1')} || ']' as code from (select distinct session_id from notes where text like '%Middlemore%') p
      union all select session_id, 'weighs', 'weighs', '[' || {_next('ID', '1')} || ']' from (select distinct session_id from notes where text like '%Weighs%') p""",
    "remove_group": ON_NOTES + "select session_id, key, original, code from codes k where not exists (from codes a where a.anchor and a.session_id = k.session_id and a.base_id = k.base_id)",
    "toggle_group": ON_NOTES + """, p as (select session_id, base_id, count(*) as n, count(*) filter (where length(key) % 3 = 0) as out from codes where type like 'person%' group by all),
      t as (select session_id, base_id, n, case when length(base_id) <> 8 then out when out = n then 0 else n end as n_excluded from p)
      select *, case when n_excluded = 0 then 'none' when n_excluded = n then 'all' else 'mixed' end as state from t""",
    "edit_words": """select case when doc_id % 3 = 0 then 'WORD' else 'Word' end || doc_id as word, case when doc_id % 3 <> 0 then 'person_other' when doc_id % 2 = 0 then 'date' else 'contact' end as type
      from documents where doc_id % 3 <> 0 or doc_id % 5 <> 0""",
}
