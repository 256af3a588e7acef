"""Clinical notes derived from `orders`: the same expressions run in Spark and in DuckDB, so that recognizers have hits and an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealgrove.sources.tables import dealt, read_table

FIRST = "Sean,Maria,Ronald,Jane,David,Sofia,Rachel,Tom,Aroha,Wiremu,Hemi,Olga,Peter,Grace,Mark,Ana,Lukas,Emma,Noah,Ines"
LAST = "Versteegh,Lintern,Smith,Wilson,Jones,Parata,Ngata,Brown,Taylor,Walker,Young,King,Wright,Scott,Green,Baker,Adams"
PLACES = "Otahuhu,Mt Eden,Ponsonby,Wellington,Dunedin,Nelson,Albany"
RELATIONS = "sister,mother,friend,Partner,uncle,flatmate"
MONTHS = "January,February,March,April,May,June,July,August,September,October,November,December"


def _pick(items: str, index: str) -> str:
    return f"split_part('{items}', ',', cast(({index}) % {items.count(',') + 1} + 1 as int))"


_D, _M, _Y = "cast(day(o_orderdate) as string)", "cast(month(o_orderdate) as string)", "cast(year(o_orderdate) as string)"
_MONTH = f"split_part('{MONTHS}', ',', cast(month(o_orderdate) as int))"
_TWO = lambda x: f"lpad({x}, 2, '0')"
DATE = (
    f"case o_orderkey % 6 when 0 then {_TWO(_D)} || '/' || {_TWO(_M)} || '/' || {_Y} when 1 then {_D} || '-' || {_M} || '-' || {_Y} when 2 then {_Y} || '-' || {_TWO(_M)} || '-' || {_TWO(_D)}"
    f" when 3 then {_MONTH} || ' ' || {_D} || ', ' || {_Y} when 4 then {_D} || ' ' || {_MONTH} || ' ' || {_Y} else {_D} || ' ' || substr({_MONTH}, 1, 3) || ' ' || {_Y} end"
)
NUMBER = "lpad(cast(o_orderkey % 10000 as string), 4, '0')"
NAME = f"{_pick(FIRST, 'o_custkey')} || ' ' || {_pick(LAST, 'o_custkey')}"
TEXT = " || ".join([
    f"case o_orderkey % 4 when 0 then 'Dr ' when 1 then 'Mrs ' when 2 then 'Ms. ' else 'Nurse ' end || {_pick(LAST, 'o_orderkey')} || ' saw ' || {NAME} || ' on ' || {DATE} || '. NHI ABC' || {NUMBER} || '.'",
    f"case o_orderkey % 3 when 0 then ' Phone 021-555-' || {NUMBER} when 1 then ' Call 09 555 ' || {NUMBER} else ' Ring +64 21 555 ' || {NUMBER} end",
    f"case when o_orderkey % 5 = 0 then ' or 0800 555 123.' else '.' end",
    f"case when o_orderkey % 4 = 1 then ' Lives at ' || cast(o_orderkey % 200 + 1 as string) || ' High Street, ' || {_pick(PLACES, 'o_custkey')} || '.' else '' end",
    f"case when o_orderkey % 2 = 0 then ' The ' || {_pick(RELATIONS, 'o_orderkey')} || ' ' || {_pick(FIRST, 'o_orderkey')} || ' came, too.' else '' end",
    f"case when o_orderkey % 8 = 0 then ' Mail ' || lower({_pick(FIRST, 'o_custkey')}) || '.' || lower({_pick(LAST, 'o_custkey')}) || '@example.co.nz now.' else '' end",
    f"case when o_orderkey % 3 = 1 then ' Prof ' || {NAME} || ' signed.' else '' end",
    f"case when o_orderkey % 6 = 2 then ' Dr ' || {_pick(FIRST, 'o_custkey')} || ' Jo ' || {_pick(LAST, 'o_custkey')} || ' read it.' else '' end",
    "case when o_orderkey % 9 = 0 then ' Seen at Middlemore Hospital.' else '' end", "case when o_orderkey % 10 = 0 then ' Referred to Auckland DHB.' else '' end",
    "case when o_orderkey % 11 = 0 then ' CHris and ITem agreed.' else '' end", f"case when o_orderkey % 12 = 0 then ' ACC 12' || {NUMBER} || ', MRN: X' || {NUMBER} || ', CR-12' || {NUMBER} || '.' else '' end",
    f"case when o_orderkey % 7 = 0 then ' {{first}} rang; Versteeg and Lintern too.' else '' end".replace("{first}", "Sean"), f"case when o_orderkey % 13 = 0 then ' Weighs 82 of 3/4, 12 34 56 and 1,250.' else '' end",
])
COLUMNS = {
    "doc_id": "o_orderkey", "session_id": "cast(o_custkey % 50 as string)", "doc_seq": "o_orderkey", "person": NAME, "text": TEXT,
}
SQL = "select " + ", ".join(f"{e} as {c}" for c, e in COLUMNS.items()) + " from orders"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, session_id, doc_seq, person, text), a note for each order."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return dealt(orders).selectExpr(*(f"{e} as {c}" for c, e in COLUMNS.items()))
