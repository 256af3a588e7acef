"""Rules over batches of plain texts: an Arrow pass in which a rule is one call for a whole batch, and places come from arrays of offsets.

Plain are texts of ASCII characters without the three that mark matches, and rules whose patterns mean the same to Arrow's expressions there as to Java's; the others are left to the native ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sealgrove.functions.scan import MENTIONS

#: Bytes of texts that are searched at once, and of the longest text that is searched here.
AT_ONCE, LONGEST = 1 << 20, 1 << 24
_PLAIN = r"\A[\x00\x04-\x7f]*\z"
_CLASS = r"\[\^?(?:[\w ./%+,:#@&;'-](?!&&)|\\[ds.\-/])+\]"
#: Letters and such, \b \d \s and escaped signs, classes of these, groups, choices, greedy repetition: nothing of which Java and Arrow think differently.
_COMMON = re.compile(rf"(?:[\w ,:;#@/%'=&<>-]|\\[bds.+\-/()\[\]]|{_CLASS}|\(\?:|\(\?-?i\)|\((?!\?)|\)|\||(?:[*+?]|\{{\d+(?:,\d*)?\}})(?![+?*{{]))*", re.ASCII)


def common(pattern: str) -> bool:
    """Whether Java and Arrow find the same in plain texts, and never an empty match."""
    if not _COMMON.fullmatch(pattern) or "&&" in pattern:
        return False
    try:
        marked = pc.replace_substring_regex(pa.array(["", " a  ab 1 1a,-.A"]), pattern=_spaced(pattern), replacement="\x01\\0\x02")
        return not any("\x01\x02" in t for t in marked.to_pylist())
    except pa.ArrowInvalid:
        return False


def _spaced(pattern: str) -> str:
    r"""Java's \s takes the vertical tab, too."""
    out, inside = [], False
    for x in re.findall(r"\\.|.", pattern, re.DOTALL):
        out.append(x if x != r"\s" else r"\t-\r " if inside else r"[\t-\r ]")
        inside = x == "[" or (inside and x != "]")
    return "".join(out)


def _cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The strings at places of a buffer."""
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    at = np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def _buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of strings."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _places(texts: pa.StringArray, pattern: str, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all matches, or of their groups, in the bytes of the texts."""
    marked = pc.replace_substring_regex(texts, pattern=pattern, replacement=f"\x01\\0\x03\\{group}\x02" if group else "\x01\\0\x02")
    _, data = _buffers(marked)
    opened, closed = np.flatnonzero(data == 1), np.flatnonzero(data == 2)
    if not group:
        begin = opened - 2 * np.arange(len(opened))
        return begin, begin + closed - opened - 1
    middle = np.flatnonzero(data == 3)
    size = closed - middle - 1
    end = opened - 3 * np.arange(len(opened)) - (np.cumsum(size) - size) + middle - opened - 1
    return end - size, end


def _apart(begin: np.ndarray, end: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Which of the spans, in order, spans.without_overlaps keeps. Spans meet only within runs that no other span reaches; the n-th spans of all runs are settled together."""
    first = np.flatnonzero(np.concatenate(([True], begin[1:] >= np.maximum.accumulate(end)[:-1])))
    size = np.diff(np.concatenate((first, [len(begin)])))
    keep = np.zeros(len(begin), bool)
    keep[first] = True
    last, first, size = first[size > 1], first[size > 1], size[size > 1]
    for n in range(1, size.max(initial=1)):
        more = size > n
        last, first, size = last[more], first[more], size[more]
        new = first + n
        apart = begin[new] >= end[last]
        wins = ~apart & ((sure[new] > sure[last]) | ((sure[new] == sure[last]) & (end[new] - begin[new] > end[last] - begin[last])))
        keep[last[wins]] = False
        keep[new] = apart | wins
        last = np.where(apart | wins, new, last)
    return keep


def _found(texts: pa.StringArray, rules: list[tuple], fields: list[pa.Field], apart: bool = False) -> pa.ListArray:
    """The mentions in each text; null for those that aren't plain. `apart`: without overlaps."""
    is_plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.less_equal(pc.binary_length(texts), LONGEST)).fill_null(False)
    texts = pc.if_else(is_plain, texts, "")
    offsets, data = _buffers(texts)
    parts = []
    for k, (pattern, group, drop, *_) in enumerate(rules):
        begin, end = _places(texts, pattern, group)
        if drop and len(begin):
            kept = ~pc.is_in(pc.ascii_lower(_cut(data, begin, end)), value_set=pa.array(drop, pa.string())).to_numpy(zero_copy_only=False)
            begin, end = begin[kept], end[kept]
        parts.append((begin, end, np.full(len(begin), k)))
    begin, end, rule = (np.concatenate(x) for x in zip(*parts, strict=True))
    row = np.searchsorted(offsets, begin, "right") - 1
    if apart and len(begin):
        rank = {x: k for k, x in enumerate(sorted({r[5:7] for r in rules}))}
        same = {x: k for k, x in enumerate(sorted({r[3:5] for r in rules}))}
        order = np.lexsort((np.array([same[r[3:5]] for r in rules])[rule], end, np.array([rank[r[5:7]] for r in rules])[rule], begin))
        order = order[_apart(begin[order], end[order], np.array([r[4] for r in rules])[rule[order]])]
    else:
        order = np.argsort(row, kind="stable")
    begin, end, rule, row = begin[order], end[order], rule[order], row[order]
    same = (pa.array([r[3 + i] for r in rules], f.type).take(pa.array(rule)) for i, f in enumerate(fields[3:]))
    columns = [pa.array(begin - offsets[row], fields[0].type), pa.array(end - offsets[row], fields[1].type), _cut(data, begin, end), *same]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
    odd = ~is_plain.to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields), mask=pa.array(odd))


def with_plain(df: DataFrame, rules: list[tuple], text: str, name: str, apart: bool = False) -> DataFrame:
    """`df` with `name`: the mentions of a plain text as MENTIONS, by rules (pattern, group, dropped, type, confidence, rec_ord, pat_ord); null where the text is none.

    `apart`: they are in order and without overlaps, and plain texts, which nothing else is looked for in, aren't handed back: null stands for them.
    """
    kind = df.sparkSession.createDataFrame([], f"x {MENTIONS}").schema["x"].dataType
    schema = StructType([*df.schema, StructField(name, kind)])
    fields, at = list(to_arrow_schema(StructType([schema[name]])).field(0).type.value_type), df.columns.index(text)
    rules, names = [(_spaced(p), *rest) for p, *rest in rules], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    own = batch.slice(a, b - a)
                    found, columns = _found(own.column(at).cast(pa.string()), rules, fields, apart), own.columns
                    if apart:
                        columns[at] = columns[at].take(pa.array(np.arange(b - a), mask=found.is_valid().to_numpy(zero_copy_only=False)))
                    yield pa.RecordBatch.from_arrays([*columns, found], names=names)

    return df.mapInArrow(run, schema)
