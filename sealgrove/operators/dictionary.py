"""Search for many words at once: the user's words, each with its own type, anywhere in a text.

The words are compiled into an Aho-Corasick automaton, once on the driver; texts are walked through in one Arrow pass, so that the time hardly depends on the number of words.
Hits of different words may overlap and lie inside other words; those of one word are taken from left to right and don't overlap. Offsets are code points of the text itself.

Case: two characters are alike if their lower-case forms are; characters whose lower-case form has another length stand for themselves, so that offsets hold.

Edge cases: null and empty texts have no hits; null, empty and blank words are left out; words are taken without white space at their ends; of a word that is listed several times, in any case,
the first entry counts, in order of (word, type); the automaton of no words finds nothing.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sealgrove.functions.scan import MENTIONS

#: Characters of all words together that an automaton may have: about 60 bytes each in every Python worker.
MAX_CHARS = 20_000_000
#: Hits of several texts that are handed over at once; those of one text stay together.
MOST_HITS = 32_768
#: Characters whose lower-case form is longer, for `folded` to leave alone.
_LONGER = {c for c in range(sys.maxunicode + 1) if len(chr(c).lower()) != 1}


def folded(text: str) -> str:
    """Lower case, character by character, so that offsets stay; a sigma at a word's end is a sigma."""
    if text.isascii():
        return text.lower()
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:
        return low
    return "".join(c if ord(c) in _LONGER else c.lower() for c in text)


class Words:
    """An automaton of words with a type each."""

    def __init__(self, words: Iterable[tuple[str | None, str]]):
        self.entries: list[tuple[str, str]] = []
        self.index: dict[str, int] = {}
        for word, kind in sorted({(w.strip(), t) for w, t in words if w and w.strip()}):
            if self.index.setdefault(folded(word), len(self.entries)) == len(self.entries):
                self.entries.append((word, kind))
        chars = sum(map(len, self.index))
        if chars > MAX_CHARS:
            raise ValueError(f"{chars} characters of words, more than MAX_CHARS = {MAX_CHARS}: search them in several passes")
        self._automaton = None

    def __len__(self) -> int:
        return len(self.entries)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # workers build their own

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for word, i in self.index.items():
                self._automaton.add_word(word, i)
            self._automaton.make_automaton()
        return self._automaton

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, entry) of all hits, by start, the longer first."""
        if not text or not self.index:
            return []
        found, reached = [], {}
        for end, i in self.automaton.iter(folded(text)):
            s = end + 1 - len(self.entries[i][0])
            if s >= reached.get(i, 0):
                reached[i] = end + 1
                found.append((s, end + 1, i))
        return sorted(found, key=lambda x: (x[0], -x[1]))

    def type_of(self, word: str) -> str | None:
        """The type of a word of the list, in any case."""
        i = self.index.get(folded(word.strip()))
        return None if i is None else self.entries[i][1]


def listed(rows: DataFrame, most: int = 2_000_000) -> Words:
    """The automaton of a table (word, type). The user's list is small beside texts; one of more than `most` rows is an error."""
    found = rows.select("word", "type").limit(most + 1).toArrow()
    if found.num_rows > most:
        raise ValueError(f"more than {most} words")
    return Words(zip(found.column("word").to_pylist(), found.column("type").to_pylist(), strict=True))


def with_hits(df: DataFrame, words: Words, text: str = "text", hits: str = "hits", excluded: Iterable[str] = (), confidence: float = 1.0, rec_ord: int = 8) -> DataFrame:
    """`df` with `hits`: the words' mentions in a text, as MENTIONS. `excluded`: words that the user wants left out, in any case, whatever list they are in."""
    out = {folded(x.strip()) for x in excluded if x}
    shared = df.sparkSession.sparkContext.broadcast(Words(x for x in words.entries if folded(x[0]) not in out))
    kind = df.sparkSession.createDataFrame([], f"x {MENTIONS}").schema["x"].dataType
    keep = [c for c in df.columns if c.lower() != hits.lower()]
    schema = StructType([*(df.schema[c] for c in keep), StructField(hits, kind)])
    arrow = to_arrow_schema(schema)
    places, at = [df.columns.index(c) for c in keep], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fields = shared.value, list(arrow.field(hits).type.value_type)

        def handed(batch: pa.RecordBatch, offsets: array, s: array, e: array, texts: list[str], types: list[str]) -> pa.RecordBatch:
            same = (pa.repeat(pa.scalar(x, f.type), len(s)) for x, f in zip((confidence, rec_ord, 0), fields[4:], strict=True))
            columns = [pa.array(x, f.type) for x, f in zip((s, e, texts, types), fields, strict=False)]
            mentions = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([*columns, *same], fields=fields))
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), mentions], names=schema.names)

        for batch in batches:
            first, offsets, s, e, texts, types = 0, array("i", [0]), array("i"), array("i"), [], []
            for row in range(batch.num_rows):
                t = batch.column(at)[row].as_py()
                for begin, end, i in own.find(t):
                    s.append(begin)
                    e.append(end)
                    texts.append(t[begin:end])
                    types.append(own.entries[i][1])
                offsets.append(len(s))
                if len(s) >= MOST_HITS or row + 1 == batch.num_rows:
                    yield handed(batch.slice(first, row + 1 - first), offsets, s, e, texts, types)
                    first, offsets, s, e, texts, types = row + 1, array("i", [0]), array("i"), array("i"), [], []

    return df.mapInArrow(run, schema)


def seen_terms(docs: DataFrame, terms: DataFrame, key: str = "key") -> DataFrame:
    """(session_id, key) of the terms (session_id, key), in lower case, that occur in a text of their session.

    All sessions' terms are in one automaton: a text is searched once, and what it holds is met with its session's terms by a join on both, so that no text is paired with a term that it
    doesn't hold. Terms beyond MAX_CHARS are searched in as many passes as they need.
    """
    spark = docs.sparkSession
    distinct = terms.select(F.col(key).alias("word"), F.lit("").alias("type")).distinct()
    total = terms.agg(F.sum(F.length(key))).first()[0] or 0
    passes = -(-int(total) // (MAX_CHARS // 2)) or 1
    found = None
    for k in range(passes):
        words = listed(distinct.filter(F.pmod(F.xxhash64("word"), F.lit(passes)) == k), MAX_CHARS)
        shared = spark.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sessions, keys = [], []
                for session, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held = {shared.value.entries[i][0] for _, _, i in shared.value.find(t)}
                    sessions += [session] * len(held)
                    keys += held
                yield pa.RecordBatch.from_arrays([pa.array(sessions, pa.string()), pa.array(keys, pa.string())], names=["session_id", key])

        own = docs.select(F.col("session_id").cast("string"), "text").mapInArrow(run, f"session_id string, {key} string").distinct()
        found = own if found is None else found.unionByName(own)
    return found
