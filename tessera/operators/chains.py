"""Chains of links, followed to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.shared import checkpointed


def resolved(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, end, hops, ring) of links (id, to): where each chain ends, after how many hops, and whether it runs into a ring.

    A chain ends at an id that links to itself or to nothing. Each round doubles the pointers, so a chain of n hops
    takes log2(n) joins; a pointer that has gone further than there are links is in a ring, and its end and hops are null.
    """
    nodes = links.select("id", F.coalesce("to", "id").alias("end")).dropDuplicates(["id"])
    state = checkpointed(nodes.select("id", "end", F.when(F.col("end") != F.col("id"), 1).otherwise(0).cast("long").alias("hops")))
    total = state.count()
    for _ in range(rounds):
        ahead = state.select(F.col("id").alias("end"), F.col("end").alias("then"), F.col("hops").alias("more"))
        joined = state.join(ahead, "end", "left").select("id", F.coalesce("then", "end").alias("new_end"), "hops", F.coalesce("more", F.lit(0)).alias("more"))
        # a ring's pointers keep growing: beyond the number of links there is no end
        grown = joined.select("id", F.col("new_end").alias("end"), F.least(F.col("hops") + F.col("more"), F.lit(total + 1)).alias("hops"), ((F.col("more") > 0) & (F.col("hops") <= total)).alias("moves"))
        state = checkpointed(grown)
        open_ = state.where("moves").isEmpty()
        state = state.drop("moves")
        if open_:
            break
    ring = F.col("hops") > total
    return state.select("id", F.when(~ring, F.col("end")).alias("end"), F.when(~ring, F.col("hops")).alias("hops"), ring.alias("ring"))
