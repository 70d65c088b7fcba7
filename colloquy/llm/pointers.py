"""Pointer jumping: chains of references resolved in a logarithmic number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut


def jump(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Follow every node's pointer to the end of its chain.

    ``nodes``: ``id`` (unique, not null), ``ptr`` (the node it points to; null for an end). Returns ``id, end``: the end of the
    chain, the node itself if it is one; null where the chain leaves the table or runs into a cycle. Each round
    replaces every open pointer by its target's pointer, so a chain of n nodes takes about log2(n) rounds. After ``max_rounds``
    (more than any 64-bit number of nodes needs) what is still open is on a cycle.

    A round joins only the open rows with the table, whose ``id`` is unique: a target that a third of all rows point to
    fills one side of one partition, which AQE's skew join splits. Rows are cut to the shared folder after each round.
    """
    end = F.col("ptr").isNull()
    state = cut(nodes.select("id", F.when(end, F.col("id")).otherwise(F.col("ptr")).alias("ptr"), end.alias("done")))
    for _ in range(max_rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        target = state.select(F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("done").alias("_done"))
        moved = state.where(~F.col("done")).join(target, F.col("ptr") == F.col("_id"), "left")
        moved = moved.select("id", F.col("_ptr").alias("ptr"), F.coalesce("_done", F.lit(True)).alias("done"))
        # settled rows stay in the table: they are targets of the open ones
        state = cut(state.where("done").unionByName(moved))
    return state.select("id", F.when(F.col("done"), F.col("ptr")).alias("end"))
