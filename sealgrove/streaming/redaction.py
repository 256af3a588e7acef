"""Redaction of documents that arrive as a stream: codes of sessions are keyed state.

Mentions are found natively, in the document's row. A session's state is its mapping, as maps in a state store on disk: a document reads and writes the entries of its
own mentions, however large the mapping is. Each document, in the order of doc_seq within a micro-batch, adds its new keys by the rules of operators.entities.assign_codes
and is redacted at once. What has been given to a key never changes. `mask_stream` has no state: types stand for what is found.
A micro-batch should be bounded by the source's options (maxFilesPerTrigger, maxBytesPerTrigger), as its documents of one session are sorted together.

Edge cases: a null text stays null; a null session_id is a session like any other; documents that come late get the next numbers, so that results equal
the batch's only if documents arrive in the order of doc_seq.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sealgrove.functions.names import NAME_TITLES
from sealgrove.functions.scan import splice
from sealgrove.functions.words import PREFIXES
from sealgrove.operators.recognizers import RULES, Rule, detect
from sealgrove.operators.spans import key_of, without_overlaps
from sealgrove.sources.tables import new_path

OUTPUT = "session_id string, doc_id long, redacted string"
#: A session's state: maps whose entries are read and written one by one.
STATES = {"codes": "code string, type string", "names": "length int, at int, base string, name string", "counts": "n int"}
#: Maps as state need this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TYPES = tuple(PREFIXES)
#: What spans.trimmed takes off an ASCII text.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b", re.ASCII)


def _letters(n: int) -> str:
    out, n = "", n + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _bare(name: str) -> list[str]:
    words = [x for x in name.split(" ") if x]
    return words[1:] if words and words[0].lower() in NAME_TITLES else words


def _variant(text: str, name: str) -> str | None:
    """The variant of the anchor `name` that a text is, if any."""
    words, low = _bare(name), " ".join(_bare(text)).lower()
    first, last, middle = words[0].lower(), words[-1].lower(), " ".join(words[1:-1]).lower()
    forms = [("FULL", " ".join(words).lower()), ("FIRST_MID", f"{first} {middle}" if middle else None), ("FIRST_LAST", first if first == last else f"{first} {last}")]
    titled = len(_bare(text)) < len([x for x in text.split(" ") if x])
    forms += [("FORMAL", last if titled else None), ("FIRST", first), ("MIDDLE", middle or None), ("LAST", last)]
    for variant, form in forms:
        if form is not None and low == form:
            return variant
    return "FIRST" if len(low) >= 3 and (first.startswith(low) or low.startswith(first)) else None


def _begins(x: str, least: int) -> list[str]:
    return [x[:k] for k in range(least, len(x) + 1)]


class Session:
    """A session's mapping over three stores with `get` and `put`, of whose entries a document reads and writes only those that it needs.

    codes: of a key its code and type. names: of a form the person who has it, as the length of the person's key, the order of registration, base and name;
    of several persons the one with the longest key, the first of equal ones. counts: of a type how many numbers it has given.
    Forms that begin with "=" are a person's, or beginnings of the first name from three letters on; with "<" first names, which texts may go beyond; with "#" whole names.
    """

    def __init__(self, codes, names, counts):
        self.codes, self.names, self.counts = codes, names, counts

    def _number(self, kind: str) -> int:
        (n,) = self.counts.get(kind) or (0,)
        self.counts.put(kind, (n + 1,))
        return n

    def _next(self, type: str) -> str:
        return f"{PREFIXES[type]}_{_letters(self._number(type))}"

    def _register(self, m: dict, words: list[str]) -> None:
        base, variant = self._next(m["type"]), "FULL" if len(words) > 2 else "FIRST_LAST"
        first, last, middle = words[0].lower(), words[-1].lower(), " ".join(words[1:-1]).lower()
        whole = " ".join(words).lower()
        forms = {whole, first, last, first if first == last else f"{first} {last}", *_begins(first, 3)} | ({middle, f"{first} {middle}"} if middle else set())
        own = (len(m["key"]), self._number("#"), base, m["text"])
        for form in (f"#{whole}", f"<{first}", *(f"={x}" for x in sorted(forms))):
            known = self.names.get(form)
            if known is None or known[0] < own[0]:
                self.names.put(form, own)
        self.codes.put(m["key"], (f"[{base}_{variant}]", m["type"]))

    def _parent(self, text: str) -> tuple | None:
        low = " ".join(_bare(text)).lower()
        met = [self.names.get(f"={low}"), *(self.names.get(f"<{x}") for x in (_begins(low, 1) if len(low) >= 3 else []))]
        return max((x for x in met if x is not None), key=lambda x: (x[0], -x[1]), default=None)

    def add(self, mentions: list[dict]) -> None:
        """Gives codes to a document's new keys: names of two words or more first."""
        for m in mentions:
            words = _bare(m["text"])
            if m["type"].startswith("person") and len(words) >= 2 and self.codes.get(m["key"]) is None and self.names.get("#" + " ".join(words).lower()) is None:
                self._register(m, words)
        for m in mentions:
            if self.codes.get(m["key"]) is not None:
                continue
            parent = self._parent(m["text"]) if m["type"].startswith("person") else None
            code = f"[{parent[2]}_{_variant(m['text'], parent[3])}]" if parent else f"[{self._next(m['type'])}]"
            self.codes.put(m["key"], (code, m["type"]))

    def redact(self, text: str, mentions: list[dict], keep_year: bool) -> str:
        out, at = [], 0
        for m in mentions:
            code, type = self.codes.get(m["key"])
            year = _YEAR.search(m["text"]) if keep_year and type == "date" else None
            out += [text[at : m["s"]], f"{code} {year.group()}" if year else code]
            at = m["e"]
        return "".join([*out, text[at:]])


class _Store:
    """A MapState of texts by text, each entry of which is read and written at most once while a session's documents of a micro-batch last."""

    def __init__(self, state):
        self.state, self.known, self.seen, self.changed = state, state.exists(), {}, set()

    def get(self, key: str) -> tuple | None:
        if key not in self.seen:
            own = self.state.getValue((key,)) if self.known else None
            self.seen[key] = None if own is None else tuple(own)
        return self.seen[key]

    def put(self, key: str, value: tuple) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), self.seen[key])


def unpacked(text: str | None, places, keys) -> list[dict]:
    """A document's mentions from their places, three numbers each, and from their keys, which only texts with other than ASCII characters bring along."""
    if text is None or places is None:
        return []
    out = []
    for k in range(0, len(places), 3):
        s, e, type = int(places[k]), int(places[k + 1]), TYPES[places[k + 2] - 1] if places[k + 2] > 0 else None
        out.append({"s": s, "e": e, "text": text[s:e], "type": type, "key": (text[s:e].strip(ASCII_SPACE).lower() if keys is None else keys[k // 3])})
    return out


class Redactor(StatefulProcessor):
    """Redacts a session's documents with its mapping as keyed state."""

    def __init__(self, keep_year: bool):
        self.keep_year = keep_year

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = [handle.getMapState(name, "item string", schema) for name, schema in STATES.items()]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stores = [_Store(x) for x in self.states]
        session = Session(*stores)
        batch = pd.concat(list(rows)).sort_values(["doc_seq", "doc_id"])
        texts = []
        for text, places, keys in zip(batch["text"], batch["places"], batch["keys"], strict=True):
            own = unpacked(text, places, keys)
            session.add(own)
            texts.append(None if text is None else session.redact(text, own, self.keep_year))
        for store in stores:
            store.flush()
        yield pd.DataFrame({"session_id": batch["session_id"], "doc_id": batch["doc_id"], "redacted": texts})

    def close(self) -> None:
        pass


def redact_stream(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_year: bool = True) -> DataFrame:
    """A stream (session_id, doc_id, redacted) of a stream of documents (session_id, doc_id, doc_seq, text). It runs with STATE_STORE set in the session."""
    kept = F.filter(without_overlaps(F.col("mentions")), lambda m: F.length(key_of(m["text"])) > 1)
    found = detect(docs, rules).select("session_id", "doc_id", "doc_seq", "text", kept.alias("_kept"))
    number = lambda m: F.array_position(F.array(*map(F.lit, TYPES)), m["type"]).cast("int")
    # Sessions' documents are shuffled and sorted with places only: a mention's text is the text's at its place.
    places = F.flatten(F.transform("_kept", lambda m: F.array(m["s"], m["e"], number(m))))
    keys = F.when(F.col("text").rlike(r"[^\x00-\x7f]"), F.transform("_kept", lambda m: key_of(m["text"])))
    found = found.select("session_id", "doc_id", "doc_seq", "text", places.alias("places"), keys.alias("keys"))
    return found.groupBy("session_id").transformWithStateInPandas(Redactor(keep_year), OUTPUT, "append", "none")


def mask_stream(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs`, a stream or not, with `masked`: each mention replaced by the prefix of its type. No state and no shuffle; one session's documents may be everywhere."""
    kept = F.filter(without_overlaps(F.col("mentions")), lambda m: F.length(key_of(m["text"])) > 1)
    prefix = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    spans = F.transform(kept, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.concat(F.lit("["), prefix[m["type"]], F.lit("]")).alias("code")))
    out = detect(docs, rules).withColumn("_spans", spans)
    return out.withColumn("masked", F.when(F.size("_spans") > 0, splice(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))).drop("_spans", "mentions")


def finished(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that has arrived by now: it runs until then, with files as its sink."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE_STORE[0]) if before is None else spark.conf.set(STATE_STORE[0], before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
