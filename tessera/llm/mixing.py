"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, running, word_count

WEIGHTS = (5, 2, 1)
#: A packet is at most this part of its source's target.
PACKETS = 2000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = 150, repeat: int = 2) -> DataFrame:
    """Words each source should give: (source, source_size, target).

    Sources in code point order, null last, take the weights in turn and share `budget_percent` of all words. A
    target stops at `repeat` times its source's words; what it leaves is shared again by weight (water filling).
    One row a source meets the others in one task; documents don't.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", (F.col("source_size") * repeat).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    each = each.withColumn("left_words", F.sum("source_size").over(everything) * float(budget_percent) / 100.0 - F.coalesce(F.sum("cap").over(before), zero))
    each = each.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    # a source is at its cap as long as an even share of what is left would be above it
    each = each.withColumn("level", F.when(F.col("cap") * F.col("left_weight") > F.col("left_words") * F.col("weight"), F.col("left_words") / F.col("left_weight")))
    level = F.max("level").over(everything)
    return each.select("source", "source_size", F.when(level.isNull() | F.col("level").isNull() & (F.col("cap") <= level * F.col("weight")), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", weights=WEIGHTS, budget_percent: int = 150, repeat: int = 2, seed: str = "mix", rows_per_bucket: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: how much of it each pass takes in a mix to target weights.

    Every source's documents are shuffled by an MD5 of seed and doc_id and queue up in that order, over and over, up to
    `repeat` passes. A copy is sent in packets of at most 1 / PACKETS of its source's target, so a long document doesn't
    hold up the others; in a large corpus nearly every copy is one packet. A packet's virtual finish is its source's
    cumulative words with it, divided by the target. All packets are ranged and sorted by virtual finish, and what the
    running sum of words leaves of the total budget is taken, the packet at the end in part. So each source ends within
    a packet of its target, or a word where packets are smaller, and all sources together at the budget.

    Columns: doc_id, source, `keep`, size, source_size, target, virtual_start, virtual_finish (of the first pass),
    pass_words (array, a number for each pass), taken (their sum). Null text or no words: size 0, taken 0. Rows that
    repeat a doc_id are documents of their own, and equal rows are interchangeable. Packets that finish at the same time
    go by the shuffle's key, doc_id and source. An empty table gives no rows. Other columns aren't read. Hot sources
    are cut into buckets of the shuffle order, so no task sorts a whole source.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    base = docs.select("doc_id", "source", kept.alias("kept"), word_count(F.col(text)).alias("size"), key.alias("key"))
    base = scratch.save(base, "sizes")
    digits = max(1, len(f"{max(1, base.count() // rows_per_bucket):x}"))
    targets = source_targets(base, weights, budget_percent, repeat)
    base = base.withColumn("bucket", F.substring("key", 1, digits))
    base = running(base, ["source"], "bucket", [F.col("key"), F.col("doc_id"), F.col("size")], F.col("size"), "before")
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    queued = scratch.save(base.join(t, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "bucket"), "queued")
    sent = cut(packets(queued.where("size > 0"), repeat), budget_percent, repeat, queued, scratch)
    same = ["doc_id", "source", "kept", "size", "source_size", "target", "before"]
    by_pass = [F.sum(F.when(F.col("pass") == k, F.col("sent")).otherwise(0)).alias(f"pass{k}") for k in range(repeat)]
    none = [F.lit(0).cast("long").alias(f"pass{k}") for k in range(repeat)]
    # packets that come too late aren't made: every document has a row without one
    idle = queued.where("size > 0").select(*same, F.lit(0).alias("pass"), F.lit(0).cast("long").alias("sent"))
    out = sent.select(*same, "pass", "sent").union(idle).groupBy(*same).agg(*by_pass)
    out = out.union(queued.where("size = 0").select(*same, *none))
    passes = [F.col(f"pass{k}") for k in range(repeat)]
    start, finish = F.col("before") / F.col("target"), (F.col("before") + F.col("size")) / F.col("target")
    return out.select(
        "doc_id", "source", *[F.col(f"kept.{c}").alias(c) for c in keep], "size", "source_size", "target",
        F.when(F.col("target") > 0, start).alias("virtual_start"), F.when(F.col("target") > 0, finish).alias("virtual_finish"),
        F.array(*passes).alias("pass_words"), sum(passes, F.lit(0).cast("long")).alias("taken"),
    )


def packets(queued: DataFrame, repeat: int) -> DataFrame:
    """The packets (words, finish) of every copy that starts before virtual time 2.

    At time 1 the budget is spent but for what the sources round down; at time 2 it is spent for sure, as every target
    is half a word or more.
    """
    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    copies = copies.withColumn("ahead", F.col("before") + F.col("source_size") * F.col("pass")).where(F.col("ahead") < 2 * F.col("target"))
    n = F.least(F.col("size"), F.ceil(F.col("size").cast("double") * PACKETS / F.col("target")))
    parts = copies.withColumn("n", n.cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    upto = lambda k: F.expr(f"size * (part + {k}) div n")
    return parts.select("*", (upto(1) - upto(0)).alias("words"), ((F.col("ahead") + upto(1)) / F.col("target")).alias("finish")).drop("n")


def cut(queue: DataFrame, budget_percent: int, repeat: int, queued: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `sent`: what of each packet goes before the budget ends, in the order of all packets' virtual finish."""
    order = ["finish", "key", "doc_id", "source", "ahead", "part"]
    # saved, so that sums and rows see the same ranges
    ranged = scratch.save(queue.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*order), "ranged")
    # a row for each range, which is one task of the sort, and for each source
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("words").alias("all")).select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    total = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("inner", F.coalesce(F.sum("words").over(within), F.lit(0))).join(starts, "range")
    room = min(total * budget_percent // 100, total * repeat) - F.col("start") - F.col("inner")
    return out.withColumn("sent", F.greatest(F.lit(0), F.least(F.col("words"), room)).cast("long"))


def schedule(mixed: DataFrame) -> DataFrame:
    """The copies of a mix in the order they are served: ranged by virtual finish over all sources."""
    copies = mixed.select("*", F.posexplode("pass_words").alias("pass", "words")).where("words > 0")
    at = F.col("virtual_finish") + F.col("pass") * F.col("source_size") / F.col("target")
    copies = copies.withColumn("finish", at).drop("pass_words", "virtual_start", "virtual_finish", "taken")
    return copies.repartitionByRange("finish", "doc_id", "pass").sortWithinPartitions("finish", "doc_id", "pass")


ORACLE = r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS k
        FROM documents
    ), s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w
        FROM d GROUP BY source
    ), l AS (
        SELECT *, (source_size * 2)::DOUBLE AS cap,
               sum(source_size) OVER ()::DOUBLE * 150.0::DOUBLE / 100.0::DOUBLE
                   - coalesce(sum(source_size * 2) OVER b, 0)::DOUBLE AS left_words,
               sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_weight
        FROM s WINDOW b AS (ORDER BY (source_size * 2)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), v AS (
        SELECT *, CASE WHEN cap * left_weight > left_words * w THEN left_words / left_weight END AS level FROM l
    ), t AS (
        SELECT source, source_size,
               CASE WHEN max(level) OVER () IS NULL OR level IS NULL AND cap <= max(level) OVER () * w THEN cap
                    ELSE max(level) OVER () * w END AS target
        FROM v
    ), c AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM d
    ), q AS (
        SELECT c.*, t.source_size, t.target, row_number() OVER () AS id FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
    ), p AS (
        SELECT *, least(size, ceil(size::DOUBLE * 2000 / target)::BIGINT) AS n, before + source_size * pass AS ahead
        FROM q, range(2) r(pass) WHERE size > 0 AND before + source_size * pass < 2 * target
    ), w AS (
        SELECT *, size * (part + 1) // n - size * part // n AS words, (ahead + size * (part + 1) // n) / target AS finish
        FROM (SELECT *, unnest(range(n)) AS part FROM p)
    ), f AS (
        SELECT id, words, (SELECT floor(least(sum(size) * 150 / 100, sum(size) * 2))::BIGINT FROM d)
               - coalesce(sum(words) OVER (ORDER BY finish, k, doc_id NULLS FIRST, source NULLS FIRST, ahead, part
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
        FROM w
    ), s AS (
        SELECT id, sum(greatest(0, least(words, room)))::BIGINT AS taken FROM f GROUP BY id
    )
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN s USING (id)
"""
