"""Conversations with tools: which messages are kept when one grows too long.

Messages: (conv_id, turn, kind, call_id); kind is `call` for a message that asks for a tool, `result` for one that answers, anything else for the rest. `turn` orders a conversation's messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pruned(messages: DataFrame, most: int = 10, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Messages of conversations, of those longer than `most` only the first and the last most - 1, and no result without its call.

    If the first of the kept last messages is a result, the last call of its id before it is kept too. Only that message can be without its call, as a call comes right before its result. Counting and looking back is
    done by windows over a conversation; no message is copied.

    Edge cases: a result whose call is missing, or whose id is null, stays alone; a call that is the first message is there already; conversations up to `most` messages stay whole; messages of equal turn are in
    order of kind and id.
    """
    order = [F.col("turn"), F.col("kind"), F.col("call_id")]
    whole = Window.partitionBy(*keys)
    out = messages.withColumns({"_i": F.row_number().over(whole.orderBy(*order)), "_n": F.count(F.lit(1)).over(whole)})
    out = out.withColumn("_edge", F.greatest(F.col("_n") - (most - 2), F.lit(1)))  # the first of the last messages
    orphan = F.max(F.when((F.col("_i") == F.col("_edge")) & (F.col("kind") == "result"), F.col("call_id"))).over(whole)
    out = out.withColumn("_orphan", orphan)
    asked = F.max(F.when((F.col("kind") == "call") & (F.col("call_id") == F.col("_orphan")) & (F.col("_i") < F.col("_edge")), F.col("_i"))).over(whole)
    keep = (F.col("_n") <= most) | (F.col("_i") == 1) | (F.col("_i") >= F.col("_edge")) | F.coalesce(F.col("_i") == F.col("_asked"), F.lit(False))
    return out.withColumn("_asked", asked).filter(keep).drop("_i", "_n", "_edge", "_orphan", "_asked")
