"""Sub-word units of texts by greedy longest match over a vocabulary table, with offsets and windows for a model.

A text's words are runs of anything but white space. The first unit of a word is looked up with the word mark before it. At each place the longest string of the vocabulary is
taken; where there is none, one character is a unit of its own: the one with the vocabulary's number for that character, or else unknown. The vocabulary is a trie, built once on the driver and broadcast.

Windows hold up to `size` units, two of them for the marks of begin and end. Nothing is cut off: a text goes on in its next window, which begins with the last `shared` units of the one before.

Edge cases: null and empty texts, and those of white space, have no units and one empty window; offsets are code points; rows of the vocabulary with a null or empty piece don't count; of a piece that is listed twice
the smaller number counts; the word mark alone is no unit.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

UNITS = "array<struct<id:int,s:int,e:int>>"
#: The mark of a word's begin, and the number of unknown units.
WORD, UNKNOWN = "▁", -1
#: Pieces that a vocabulary may have, and words that a task remembers, with up to 16 units a word.
MAX_PIECES, CACHE = 4_000_000, 200_000
#: Units of several texts that are handed over at once; those of one text stay together.
MOST_UNITS = 65_536
#: Characters of a text, up to the next white space, whose words are looked up at once.
AT_ONCE = 1 << 20
#: Whether characters are white space; there is none behind the last of these.
SPACE = np.array([chr(k).isspace() for k in range(0x3002)])
_GAP = re.compile(r"\s")


class Vocabulary:
    """Pieces with numbers, as a trie: node and character to the next node, and the number at a node, if it ends a piece."""

    def __init__(self, pieces: Iterable[tuple[str | None, int]]):
        self.child: dict[tuple[int, str], int] = {}
        self.number: list[int | None] = [None]
        for piece, n in sorted((p, n) for p, n in pieces if p):
            node = 0
            for x in piece:
                node = self.child.setdefault((node, x), len(self.number))
                if node == len(self.number):
                    self.number.append(None)
            if self.number[node] is None:
                self.number[node] = n
        self.forget()

    def forget(self) -> None:
        """Forgets the words seen: numbers of words, and their units in columns, those of a word from `begin` on."""
        self.words: dict[str, int] = {}
        self.begin, self.columns = array("q", [0]), [array("i") for _ in range(3)]

    def __getstate__(self) -> dict:
        return {"child": self.child, "number": self.number}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.forget()

    def longest(self, word: str, at: int, node: int = 0) -> tuple[int, int | None]:
        """Where the longest piece from a place on ends, and its number."""
        end, found = at, None
        for k in range(at, len(word)):
            node = self.child.get((node, word[k]))
            if node is None:
                break
            if self.number[node] is not None:
                end, found = k + 1, self.number[node]
        return end, found

    def _alone(self, piece: str) -> int | None:
        end, found = self.longest(piece, 0)
        return found if end == len(piece) else None

    def units(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(number, start, end) of a word's units."""
        at, mark = 0, self.child.get((0, WORD))
        while at < len(word):
            end, n = self.longest(word, at, mark) if at == 0 and mark is not None else (at, None) if at == 0 else self.longest(word, at)
            if n is None:
                end, n = at + 1, self._alone(word[at])
            yield UNKNOWN if n is None else n, at, end
            at = end

    def _number(self, word: str) -> int:
        known = self.words.get(word)
        if known is None:
            for unit in self.units(word):
                for c, x in zip(self.columns, unit, strict=True):
                    c.append(x)
            known = len(self.begin) - 1
            self.begin.append(len(self.columns[0]))
            if len(word) <= 40:
                self.words[word] = known
        return known

    def of_text(self, text: str | None) -> np.ndarray:
        """Numbers, starts and ends of a text's units, as rows."""
        parts, at = [np.zeros((3, 0), np.int32)], 0
        while text and at < len(text):
            gap = _GAP.search(text, at + AT_ONCE)
            own = text[at : gap.start() if gap else len(text)]
            known = list(map(self.words.get, words := own.split()))
            if None in known:
                known = [self._number(w) if n is None else n for w, n in zip(words, known, strict=True)]
            space = SPACE[np.minimum(np.frombuffer(own.encode("utf-32-le"), np.uint32), len(SPACE) - 1)]
            start = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) + at
            known, begin = np.array(known, np.int64), np.frombuffer(self.begin, np.int64)
            count = begin[known + 1] - begin[known]
            which = np.repeat(begin[known] - np.cumsum(count) + count, count) + np.arange(count.sum())
            part = np.stack([np.frombuffer(c, np.int32)[which] if len(which) else np.zeros(0, np.int32) for c in self.columns])
            part[1:] += np.repeat(start, count).astype(np.int32)
            parts.append(part)
            at += len(own)
            if len(self.begin) > CACHE or len(self.columns[0]) > 16 * CACHE:
                self.forget()
        return np.concatenate(parts, axis=1)


def vocabulary(table: DataFrame) -> Vocabulary:
    """The trie of a table (piece, id); its size is the vocabulary's, whatever the texts."""
    found = table.select("piece", "id").limit(MAX_PIECES + 1).toArrow()
    if found.num_rows > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return Vocabulary(zip(found.column("piece").to_pylist(), found.column("id").to_pylist(), strict=True))


def with_units(df: DataFrame, words: Vocabulary, text: str = "text", units: str = "units") -> DataFrame:
    """`df` with `units`: (id, s, e) of the text's units, in one Arrow pass without a shuffle; an existing column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    kind = df.sparkSession.createDataFrame([], f"x {UNITS}").schema["x"].dataType
    keep = [c for c in df.columns if c.lower() != units.lower()]
    schema = StructType([*(df.schema[c] for c in keep), StructField(units, kind)])
    fields = list(to_arrow_schema(schema).field(units).type.value_type)
    places, at = [df.columns.index(c) for c in keep], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(batch: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
            made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(np.concatenate(found, axis=1), fields, strict=True)], fields=fields)
            offsets = np.cumsum([0, *(x.shape[1] for x in found)])
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)], names=schema.names)

        for batch in batches:
            first, found, n = 0, [], 0
            for row in range(batch.num_rows):
                found.append(shared.value.of_text(batch.column(at)[row].as_py()))
                n += found[-1].shape[1]
                if n >= MOST_UNITS or row + 1 == batch.num_rows:
                    yield handed(batch.slice(first, row + 1 - first), found)
                    first, found, n = row + 1, [], 0

    return df.mapInArrow(run, schema)


def windows(units: Column, size: int = 512, shared: int = 0) -> Column:
    """array<struct<window, first, units>>: a text's units in windows of up to size - 2, each beginning with the last `shared` of the one before."""
    room, n = size - 2, F.size(units)
    step = room - shared
    last = F.when(n <= room, F.lit(0)).otherwise(F.ceil((n - room) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("window"), (k * step).alias("first"), F.slice(units, k * step + 1, F.lit(room)).alias("units")))


def model_input(units: Column, begin: int, end: int, pad: int, size: int = 512) -> tuple[Column, Column]:
    """(ids, mask) of a window: begin, units, end, and padding up to `size`."""
    ids = F.concat(F.array(F.lit(begin)), F.transform(units, lambda u: u["id"]), F.array(F.lit(end)))
    fill = F.greatest(F.lit(size) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad), fill)), F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill))
