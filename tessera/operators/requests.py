"""Requests for load tests: lengths, token lists, recycled rows, order, batch latencies. Draws are hashes, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.mix import draw
from tessera.operators.sequence import numbered


def drawn_int(key: Column, low: int, high: int, seed: int = 0) -> Column:
    """A number of low to high - 1 from a hash of the key."""
    return (F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % (high - low) + low).cast("int")


def drawn_length(key: Column, full: int, share: float, seed: int = 0) -> Column:
    """A length between a share of the full one, one at least, and the full one."""
    return drawn_int(key, max(1, int(full * share)), full + 1, seed)


def of_length(tokens: Column, n: Column) -> Column:
    """Exactly n tokens: cut, or repeated from the start as often as needed. An empty list stays empty."""
    times = F.ceil(n / F.greatest(F.lit(1), F.size(tokens))).cast("int")
    return F.slice(F.flatten(F.array_repeat(tokens, F.greatest(F.lit(1), times))), 1, n)


def counting_tokens(offset: Column, row: Column, n: Column, vocabulary: int) -> Column:
    """n tokens that count up from offset plus the row's number, modulo the vocabulary."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: ((offset + row + j) % vocabulary).cast("int"))


def recycled(df: DataFrame, order: list[str], requests: int) -> DataFrame:
    """So many rows, in order and over and over, numbered from 0 in `request`."""
    n = df.count()
    if not n:
        return df.withColumn("request", F.lit(0).cast("long"))
    rows = numbered(df, order, "request", start=0)
    rounds = F.sequence(F.lit(0), F.lit(-(-requests // n) - 1)) if requests > 0 else F.array().cast("array<int>")
    rows = rows.withColumn("_round", F.explode(rounds)).withColumn("request", F.col("request") + F.col("_round") * F.lit(n).cast("long"))
    return rows.where(F.col("request") < requests).drop("_round")


def longest_first(df: DataFrame, output: str, tie: str) -> DataFrame:
    """Adds `place`: requests of the longest expected output first."""
    return numbered(df.withColumn("_less", -F.col(output)), ["_less", tie], "place", start=1).drop("_less")


def batch_latency(df: DataFrame, group: str, step: str, seconds: str, batch: Column, inputs: Column, outputs: Column) -> DataFrame:
    """Of each run's steps, 0 being the prefill: prefill throughput, the decode steps' median latency, overall throughput."""
    decode = F.when(F.col(step) > 0, F.col(seconds))
    prefill = F.sum(F.when(F.col(step) == 0, F.col(seconds)))
    return df.groupBy(group).agg(
        F.try_divide(F.max(batch * inputs), prefill).alias("prefill_throughput"), F.median(decode).alias("median_decode_latency"),
        F.try_divide(F.max(batch * (inputs + outputs)), F.sum(seconds)).alias("overall_throughput"),
    )
