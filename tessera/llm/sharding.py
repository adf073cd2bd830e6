"""Sharding by balanced label propagation."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, running

#: A hash's share of the unit interval.
UNIT = float(1 << 63)


def unit(*cols) -> F.Column:
    """A hash of the columns, even over [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) / F.lit(UNIT)


def propagate(cells: DataFrame, shards: int, capacity: int, rounds: int, scratch: Scratch) -> DataFrame:
    """Moves linked documents towards the shard that holds most of their group.

    `cells` has a row for each group and shard, with n documents there: a group's documents in one shard are alike, so
    a round moves counts, and a group of any size is at most `shards` rows. In a round each cell asks to join the
    largest cell of its group among shards with room; all that ask for a shard get the same share of its room, as
    whole documents by a hash's rounding. Rounds end when no cell asks; each move raises the sum of the cells' squares,
    so they do end. A warning tells if `rounds` were not enough. The driver sees one row a shard.
    """
    for step in range(rounds):
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, capacity - loads.get(s, 0)) for s in range(shards)]
        space = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("shard") + 1)
        best = cells.groupBy("g").agg(
            F.max(F.when(space > 0, F.struct("n", F.xxhash64("g", "shard", F.lit(step)).alias("tie"), "shard"))).alias("best"), F.count("*").alias("parts")
        )
        asked = cells.join(best.where("parts > 1 AND best IS NOT NULL"), "g", "left")
        asked = asked.withColumn("to", F.when((F.col("best.shard") != F.col("shard")) & (F.col("n") <= F.col("best.n")), F.col("best.shard")))
        asked = scratch.save(asked.select("g", "shard", "n", "to"), "asked")
        wanted = {r["to"]: r["n"] for r in asked.where("`to` IS NOT NULL").groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not wanted:
            return cells
        shares = F.array(*[F.lit(min(1.0, room[s] / wanted[s]) if s in wanted else 0.0) for s in range(shards)])
        moved = F.floor(F.col("n") * F.element_at(shares, F.col("to") + 1) + unit(F.col("g"), F.col("shard"), F.lit(step)))
        asked = asked.withColumn("moved", F.when(F.col("to").isNull(), 0).otherwise(F.least(moved, F.col("n"))))
        after = asked.select("g", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")))).alias("c"))
        after = after.where("c.n > 0").groupBy("g", F.col("c.shard").alias("shard")).agg(F.sum("c.n").alias("n"))
        cells = scratch.save(after, "cells")
        scratch.drop(asked)
    warnings.warn(f"label propagation ended after {rounds} rounds, before it converged", stacklevel=2)
    return cells


def shard(docs: DataFrame, shards: int = 40, text: str = "text", rounds: int | None = None, rows_per_bucket: int = 20_000) -> DataFrame:
    """Puts every document into one of `shards` shards whose row counts differ by one at most (law `rows`).

    Documents of equal text are linked. All start in a shard by hash; balanced label propagation gathers groups under
    the shards' capacity until no group gains (or for `rounds`, by default 10 a shard); then documents above a shard's quota, those without links first, go to shards below theirs.
    A group is split only if it is larger than a shard, or where no shard has room for it.

    Columns: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot (gapless from 0 in a shard),
    grown_shard (null: the law isn't `key`), group_id. Null texts: size 16, text_crc32 and group_id null, no links.
    Repeated rows are documents of their own. Fewer rows than shards: some shards stay empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    t = F.col(text)
    group = F.when(t.isNotNull(), F.xxhash64(t, F.crc32(t.cast("binary")), F.octet_length(t)))
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), group.alias("g")
    )
    spread = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), F.col("text_crc32"))
    base = scratch.save(base.withColumn("h", spread), "rows")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod("h", F.lit(shards)).cast("int")
    cells = base.where("g IS NOT NULL").groupBy("g", start.alias("shard")).agg(F.count("*").alias("n"))
    linked = cells.groupBy("g").agg(F.sum("n").alias("all"))
    cells = scratch.save(cells.join(linked.where("all > 1").select("g"), "g"), "cells")
    cells = propagate(cells, shards, max(1, total // shards), 10 * shards if rounds is None else rounds, scratch)
    # a group's shards as shares of the unit interval: each of its documents falls into one by its hash
    by_size = Window.partitionBy("g").orderBy(F.desc("n"), "shard")
    ends = cells.withColumn("end", F.sum("n").over(by_size) / F.sum("n").over(Window.partitionBy("g")))
    homes = ends.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("homes"))
    out = base.join(homes, "g", "left")
    # hash anew: h has already chosen the first shard
    home = F.filter("homes", lambda x: x["end"] > unit(F.col("h"), F.lit("home")))
    out = out.withColumn("linked", F.col("homes").isNotNull())
    out = out.withColumn("first", F.when(F.col("linked"), F.coalesce(F.try_element_at(home, F.lit(1))["shard"], F.element_at("homes", -1)["shard"])).otherwise(start))
    # linked documents come first in their shard, so it's the others that leave a full one
    buckets = max(1, total // (shards * rows_per_bucket))
    out = out.withColumn("bucket", F.when(F.col("linked"), 0).otherwise(buckets) + F.pmod(F.xxhash64("h", F.lit("bucket")), F.lit(buckets)))
    out = scratch.save(out.drop("homes"), "first")
    out = running(out, ["first"], "bucket", [F.col("g"), F.col("h"), F.col("doc_id"), F.col("size")], F.lit(1), "place")
    held = {r["first"]: r["count"] for r in out.groupBy("first").count().collect()}
    over, under, extra, free = [], [], 0, 0
    for s in range(shards):
        over.append(extra)
        under.append(free)
        extra += max(0, held.get(s, 0) - quota[s])
        free += max(0, quota[s] - held.get(s, 0))
    ints = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    own = F.element_at(ints(quota), F.col("first") + 1)
    rank = F.element_at(ints(over), F.col("first") + 1) + F.col("place") - own
    # gaps[k] to gaps[k + 1] are the free slots of the k-th shard below its quota
    gaps = [s for s in range(shards) if quota[s] > held.get(s, 0)] or [0]
    which = F.size(F.filter(ints([under[s] for s in gaps]), lambda x: x <= rank))
    goes = F.element_at(ints(gaps), which)
    slot = F.element_at(ints([held.get(s, 0) for s in gaps]), which) + rank - F.element_at(ints([under[s] for s in gaps]), which)
    out = out.withColumn("leaves", F.col("place") >= own)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(F.col("leaves"), goes).otherwise(F.col("first")).cast("int").alias("shard"),
        F.when(F.col("leaves"), slot).otherwise(F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("g").alias("group_id"),
    )
