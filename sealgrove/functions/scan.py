"""Regular-expression scans that keep offsets, as expressions; the kernel of all recognizers.

All of them take time in proportion to the text and its hits: what a fold gathers is copied within blocks of BLOCK items only, and a text is cut into the parts of blocks before it is
cut at spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int,t:string>>"
MENTIONS = "array<struct<s:int,e:int,text:string,type:string,confidence:double,rec_ord:int,pat_ord:int>>"
#: Items of an array that are folded together.
BLOCK = 128


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items; an empty one gives one empty block."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def folded(items: Column, kind: str, state: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """(state, out) of a fold over an array in which `step(state, item)` gives the next state and the items, as an array of type `kind`, that go to `out`."""

    def one(acc: Column, x: Column) -> Column:
        new, more = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, items_: Column) -> Column:
        inner = F.aggregate(items_, F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(in_blocks(items), start, block, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))


def scannable(text: Column) -> Column:
    """The text without the three control characters that mark matches; other characters stand in for them, at the same offsets."""
    return F.when(text.rlike("[\x01-\x03]"), F.translate(text, "\x01\x02\x03", "�" * 3)).otherwise(text)


def scan(text: Column, pattern: str | Column, group: int = 0, clean: bool = False) -> Column:
    """All matches in a text as [start, end) in code points with their text. A group is one that ends where its match ends.

    One search marks the matches; the lengths of the pieces between the marks give the offsets. `clean`: the text is scannable already.
    """
    return let(marked(text if clean else scannable(text), pattern, group), lambda m: spans_of(m, group))


def marked(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """A scannable text with marks around its matches."""
    return F.regexp_replace(text, pattern, f"\x01$0\x03${group}\x02" if group else "\x01$0\x02")


def spans_of(marked: Column, group: int = 0) -> Column:
    """The spans of a marked text; most texts have no match of a pattern, and few have more than BLOCK, whose starts are lengths of what stands before them instead of a fold's sums."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        close, mid = F.instr(x, "\x02"), F.instr(x, "\x03")
        whole = (mid if group else close) - 1
        size = close - mid - 1 if group else whole
        span = F.struct((at + whole - size).alias("s"), (at + whole).alias("e"), F.substring(x, mid + 1 if group else F.lit(1), size).alias("t"))
        return at + whole + F.length(x) - close, F.array(span)

    def many(pieces: Column) -> Column:
        return folded(F.slice(pieces, F.lit(2), F.size(pieces)), SPANS, F.length(F.get(pieces, F.lit(0))), step)["out"]

    def few(pieces: Column) -> Column:
        before = lambda i: F.length(F.call_function("substring_index", marked, F.lit("\x01"), i + 1)) - 2 * i
        found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x, i: F.struct(before(i).alias("s"), F.substring_index(x, "\x02", 1).alias("t")))
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["t"])).alias("e"), x["t"].alias("t")))

    spans = lambda pieces: many(pieces) if group else F.when(F.size(pieces) > BLOCK, many(pieces)).otherwise(few(pieces))
    return F.when(F.contains(marked, F.lit("\x01")), let(F.split(marked, "\x01", -1), spans)).when(marked.isNotNull(), F.array().cast(SPANS))


def splice(text: Column, spans: Column) -> Column:
    """`text` with each of `spans` (sorted structs of s, e and code) replaced by its code. Spans that overlap are an error: what is put in place of one would be cut by the other."""
    n = F.size(spans)
    apart = F.forall(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(spans, i)["e"] <= F.element_at(spans, i + 1)["s"])

    def block(own: Column, b: Column) -> Column:
        base = F.when(b == 0, F.lit(0)).otherwise(F.element_at(spans, F.greatest(b * BLOCK, F.lit(1)))["e"])
        part = F.struct(own.alias("own"), base.alias("base"), F.substring(text, base + 1, F.element_at(own, -1)["e"] - base).alias("text"))

        def joined(p: Column) -> Column:
            before = lambda i: F.when(i == 0, p["base"]).otherwise(F.get(p["own"], i - 1)["e"])
            return F.array_join(F.transform(p["own"], lambda x, i: F.concat(F.substring(p["text"], before(i) - p["base"] + 1, x["s"] - before(i)), x["code"])), "")

        return let(part, joined)

    done = F.concat(F.array_join(F.transform(in_blocks(spans), block), ""), F.substring(text, F.element_at(spans, -1)["e"] + 1, F.length(text)))
    return F.when(n == 0, text).when(apart, done).otherwise(F.raise_error(F.lit("spans overlap")).cast("string"))
