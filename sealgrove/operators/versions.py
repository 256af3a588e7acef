"""Source documents over time: a history of saves, descriptions, deletions and clears as intervals, and the state at any step.

Changes: (session_id, at, kind, doc_id, text); `at` orders a session's changes and is its own for each.

* draft (doc_id, text): the document at hand has this text, in place of any other draft
* save (doc_id): the draft becomes a saved document, under its text; a document that is saved again has a new version
* describe (doc_id, text): a saved document has this description from now on
* delete (doc_id): the saved document goes, with its description
* clear: the draft goes; saved documents, and the mapping of the session, stay

Every version is valid from its change on up to, but without, the change that ends it. All of it is windows over the changes of a session and of a document; nothing is replayed.

Edge cases: a save without a draft of that id, a description or deletion of a document that isn't saved, and unknown kinds do nothing; null sessions and doc_ids are values like any other; an empty history has no versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.operators.joins import joined

CHANGES = "session_id string, at long, kind string, doc_id long, text string"


def versions(changes: DataFrame) -> DataFrame:
    """(session_id, item, doc_id, text, valid_from, valid_to): item is `draft`, `saved` or `described`; valid_to is null for what still holds."""
    session = Window.partitionBy("session_id").orderBy("at")
    document = Window.partitionBy("session_id", "doc_id").orderBy("at")
    ahead = (Window.unboundedPreceding, -1)
    # What comes behind is what comes before in descending order: Spark goes over the rest of a group again for each row of a frame that ends with the group.
    session_back, document_back = Window.partitionBy("session_id").orderBy(F.desc("at")), Window.partitionBy("session_id", "doc_id").orderBy(F.desc("at"))
    own = changes.filter(F.col("kind").isin("draft", "save", "describe", "delete", "clear"))

    # Drafts hold until the next draft or clear of the session.
    ends = F.min(F.when(F.col("kind").isin("draft", "clear"), F.col("at"))).over(session_back.rowsBetween(*ahead))
    last = F.last(F.when(F.col("kind").isin("draft", "clear"), F.struct("kind", "doc_id", "text")), ignorenulls=True).over(session.rowsBetween(*ahead))
    own = own.withColumns({"_ends": ends, "_draft": last})
    drafts = own.filter("kind = 'draft'").select("session_id", F.lit("draft").alias("item"), "doc_id", "text", F.col("at").alias("valid_from"), F.col("_ends").alias("valid_to"))

    # Saves that found their draft, and deletions, decide what of a document is saved.
    real = (F.col("kind") == "save") & (F.col("_draft.kind") == "draft") & F.col("_draft.doc_id").eqNullSafe(F.col("doc_id"))
    own = own.withColumn("_kind", F.when(real, "save").when(F.col("kind") != "save", F.col("kind"))).filter(F.col("_kind").isin("save", "delete", "describe"))
    state = F.last(F.when(F.col("_kind").isin("save", "delete"), F.col("_kind")), ignorenulls=True).over(document.rowsBetween(*ahead))
    stops = F.min(F.when(F.col("_kind").isin("save", "delete"), F.col("at"))).over(document_back.rowsBetween(*ahead))
    gone = F.min(F.when(F.col("_kind") == "delete", F.col("at"))).over(document_back.rowsBetween(*ahead))
    told = F.min(F.when(F.col("_kind") == "describe", F.col("at"))).over(document_back.rowsBetween(*ahead))
    own = own.withColumns({"_state": state, "_stops": stops, "_gone": gone, "_told": told})
    saved = own.filter("_kind = 'save'").select("session_id", F.lit("saved").alias("item"), "doc_id", F.col("_draft.text").alias("text"), F.col("at").alias("valid_from"), F.col("_stops").alias("valid_to"))
    described = own.filter("_kind = 'describe' and _state = 'save'")
    described = described.select("session_id", F.lit("described").alias("item"), "doc_id", "text", F.col("at").alias("valid_from"), F.least("_gone", "_told").alias("valid_to"))
    return drafts.unionByName(saved).unionByName(described)


def state_at(history: DataFrame, steps: DataFrame) -> DataFrame:
    """(session_id, at, item, doc_id, text): what holds after the step `at` of a session, for each of the steps (session_id, at).

    Steps are numbered by session; a version learns the number of the steps before its start and before its end by going along the session's steps in order, and has a row for each step between, so
    that the work grows with versions, steps and what comes out, not with their products.
    """
    s = steps.filter("at is not null").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("at")))
    # Versions come before a step at the same place: those that start there hold at it, those that end there don't.
    order = Window.partitionBy("session_id").orderBy(F.col("_t").asc_nulls_last(), "_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ticks = s.select("session_id", F.col("at").alias("_t"), F.lit(1).alias("_step"))

    def counted(rows: DataFrame, at: str, name: str) -> DataFrame:
        both = rows.withColumns({"_t": F.col(at), "_step": F.lit(0)}).unionByName(ticks, allowMissingColumns=True)
        return both.withColumn(name, F.sum("_step").over(order)).filter("_step = 0").drop("_t", "_step")

    h = history.filter("valid_from is not null").select("session_id", "item", "doc_id", "text", "valid_from", "valid_to")
    h = counted(counted(h, "valid_from", "_from"), "valid_to", "_to").filter("_from < _to")
    held = h.select("session_id", "item", "doc_id", "text", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_n"))
    return joined(held, s.withColumn("_n", F.col("_n").cast("long")), ("session_id", "_n")).select("session_id", "at", "item", "doc_id", "text")
