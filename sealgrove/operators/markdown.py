"""Markdown as the display shows it: blocks of a text, and runs of styles within their lines.

Blocks: headings of level 1 to 6, rules, tables, bullet and numbered lists, nested by their indent, paragraphs. Runs: `strong`, `emphasis`, both, and `code`, found with a stack of open delimiters in one walk over a line.

Delimiters are runs of one to three * or _. One opens before anything but white space and closes behind it; it closes the latest open delimiter of its character and length, and what was opened in between is plain text. An
underscore within a word is no delimiter, and nothing is one within brackets, so that placeholders as [PERSON_A_FIRST] stay as they are. Code between backticks is taken as it is.

Edge cases: null and empty texts have no blocks and no runs; an empty pair of delimiters is plain text; a table needs no header; offsets are code points of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<block:int,kind:string,level:int,s:int,e:int>>"
RUNS = "array<struct<s:int,e:int,style:string>>"
_LINE = re.compile(r"(?P<heading>(?P<marks>#{1,6})[ \t]+)|(?P<rule>(?:-{3,}|\*{3,}|_{3,})[ \t]*$)|(?P<table>\|)|(?P<bullet>[-*+][ \t]+)|(?P<number>\d+[.)][ \t]+)")
STYLES = {1: "emphasis", 2: "strong", 3: "strong emphasis"}


def blocks_of(text: str | None) -> list[tuple[int, str, int, int, int]]:
    """(block, kind, level, start, end) of each line's content, in order; lines of one table, list or paragraph share a number. The level of an item is how many items are open around it, itself included."""
    out: list[tuple[int, str, int, int, int]] = []
    at, block, before, indents = 0, -1, "", []
    for line in (text or "").split("\n"):
        stripped = line.strip(" \t\r")
        start, begin = at, at + len(line) - len(line.lstrip(" \t"))
        at += len(line) + 1
        end = start + len(line.rstrip(" \t\r"))
        if not stripped:
            before = "" if before not in ("bullet", "number") else before  # a list goes on behind an empty line
            continue
        m = _LINE.match(stripped)
        kind = m.lastgroup if m and m.lastgroup != "marks" else "paragraph"
        kind = "heading" if m and m.group("heading") else kind
        level = len(m.group("marks")) if kind == "heading" else 0
        indent = len(line[: begin - start].expandtabs(4))
        if kind in ("bullet", "number"):
            top = indents[0][1] if indents else None
            while indents and indents[-1][0] > indent:
                indents.pop()
            if not indents or indents[-1][0] < indent:
                indents.append((indent, kind))
            indents[-1], level = (indent, kind), len(indents)
            begin += m.end()
            joins = before in ("bullet", "number") and (level > 1 or top == kind)
        else:
            joins = kind == before and kind in ("table", "paragraph")
            indents = []
            begin += m.end() if kind == "heading" else 0
        block += not joins
        before = kind
        out.append((block, kind, level, begin, max(begin, end)))
    return out


def runs_of(line: str, at: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, style) of a line's styled runs, without their delimiters, by start; runs may lie within each other."""
    out: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = []  # delimiters that are open, with where their content begins
    i, inside, n = 0, 0, len(line)
    while i < n:
        x = line[i]
        if x == "`":
            size = len(line) - i - len(line[i:].lstrip("`"))
            end = line.find("`" * size, i + size)
            if end > i + size:
                out.append((at + i + size, at + end, "code"))
                i = end + size
            else:
                i += size
            continue
        if x in "[]":
            inside = 1 if x == "[" and "]" in line[i:] else 0
        elif x in "*_" and not inside:
            size = 1
            while i + size < n and line[i + size] == x:
                size += 1
            mark, behind, ahead = x * size, line[i - 1] if i else " ", line[i + size] if i + size < n else " "
            word = x == "_" and (behind.isalnum() and ahead.isalnum())
            opened = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == mark), None)
            if size <= 3 and not word:
                if opened is not None and not behind.isspace() and stack[opened][1] < i:
                    out.append((at + stack[opened][1], at + i, STYLES[size]))
                    del stack[opened:]
                elif not ahead.isspace():
                    stack.append((mark, i + size))
            i += size
            continue
        i += 1
    return sorted(out, key=lambda r: (r[0], -r[1], r[2]))


def _column(f: Callable[[str | None], list[tuple]], kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [x.split(":")[0] for x in kind[len("array<struct<") : -2].split(",")]
        for some in texts:
            yield some.map(lambda t: [dict(zip(names, x, strict=True)) for x in f(t)])

    return run


def _runs(text: str | None) -> list[tuple[int, int, str]]:
    return [r for _, kind, _, s, e in blocks_of(text) if kind not in ("rule",) for r in runs_of((text or "")[s:e], s)]


def with_markdown(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `blocks` and `runs` of a text, in one pass without a shuffle; existing columns of these names are replaced."""
    return df.withColumns({"blocks": _column(blocks_of, BLOCKS)(F.col(text)), "runs": _column(_runs, RUNS)(F.col(text))})


def plain(text: Column, runs: Column) -> Column:
    """The texts of runs, with their style: what the display would show apart."""
    return F.transform(runs, lambda r: F.struct(r["style"].alias("style"), F.substring(text, r["s"] + 1, r["e"] - r["s"]).alias("text")))
