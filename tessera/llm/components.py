"""Connected components by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Edges that a task of a step handles.
EDGES = 100_000


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of an edge table (a, b), root being the smallest of its component.

    Alternates large-star and small-star steps until the edges are stars. A large-star step joins each vertex's edges
    with the one row of its smallest neighbour, so a hub is a skewed join that Spark splits, never a collected group; a
    small-star step orders each vertex's smaller neighbours, of which large-star steps leave few. Loops and repeated
    edges don't matter. A step's tasks follow from the number of edges.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    e = scratch.save(e, "edges")
    parts = max(8, -(-e.count() // EDGES))
    mark = None
    for _ in range(rounds):
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y"))).coalesce(parts)
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).coalesce(parts)
        small = large.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        small = small.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("s"))
        new = scratch.save(small.select("s.v", "s.u").where("v <> u").coalesce(parts).distinct().coalesce(parts), "edges")
        scratch.drop(e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("h"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).collect()[0]
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    return e.select("v", F.col("u").alias("root")).union(e.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct().coalesce(parts))
