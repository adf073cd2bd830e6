"""Request statistics, histograms, rolling means, gaps, arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import running_sum

# Upper bounds of latency histograms, in seconds.
TTFT = (0.1, 0.2, 0.4, 0.6, 0.8, 1, 2, 4, 6, 8, 10, 20, 40, 60, 80, 100, 200, 400)
E2E = (0.1, 0.2, 0.4, 0.6, 0.8, 1, 2, 4, 6, 8, 10, 20, 40, 60, 80, 100, 200, 400, 800)
ITL = (0.002, 0.004, 0.006, 0.008, 0.010, 0.015, 0.020, 0.025, 0.030, 0.035, 0.040, 0.060, 0.080, 0.100, 0.200, 0.400, 0.600, 0.800, 1.000, 2.000, 4.000, 6.000, 8.000)


def statistics(value: Column, name: str, digits: int = 6) -> list[Column]:
    """mean, median, population deviation, p95, p99 and maximum; 0 for no values."""
    pick = {"mean": F.avg(value), "median": F.percentile(value, 0.5), "std": F.stddev_pop(value), "p95": F.percentile(value, 0.95), "p99": F.percentile(value, 0.99), "max": F.max(value)}
    return [F.round(F.coalesce(c, F.lit(0.0)), digits).alias(f"{k}_{name}") for k, c in pick.items()]


def tpot(latency: Column, ttft: Column, output_len: Column) -> Column:
    """Time per output token after the first; null for outputs of one token."""
    return F.when(output_len > 1, (latency - ttft) / (output_len - 1))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], weight: Column | None = None) -> DataFrame:
    """(le, count, cumulative): each value in the first bucket whose bound isn't below it; the last bucket is unbounded.

    Values are counted by bucket on the map side; only one row a bucket meets the others.
    """
    le = F.lit(float("inf"))
    for b in reversed(bounds):
        le = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(le)
    counts = df.where(F.col(value).isNotNull()).groupBy(le.alias("le")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    edges = df.sparkSession.createDataFrame([(float(b),) for b in (*bounds, float("inf"))], "le double")
    every = edges.join(counts, "le", "left").select("le", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
    w = Window.orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("cumulative", F.sum("count").over(w))


def rolling_mean(value: str, rows: int, group: str, order: list[str]) -> Column:
    return F.avg(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(-(rows - 1), 0))


def gaps(df: DataFrame, group: str, at: str, order: list[str], tokens: Column) -> DataFrame:
    """Time since the row before, shared by the row's tokens: one row a token; a group's first row gives none."""
    w = Window.partitionBy(group).orderBy(*order)
    gap = df.withColumn("_gap", (F.col(at) - F.lag(at).over(w)) / tokens).where("_gap IS NOT NULL")
    return gap.withColumn("gap", F.explode(F.array_repeat("_gap", tokens.cast("int")))).drop("_gap")


def poisson_arrivals(df: DataFrame, order: str, rate: float, seed: int = 0) -> DataFrame:
    """Adds exponential gaps from a hash of the row and seed, and arrival times, their running sum."""
    u = (F.conv(F.substring(F.md5(F.concat(F.col(order).cast("string"), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    df = df.withColumn("gap", -F.log(1 - u) / rate)
    return running_sum(df, [order], "gap", "arrival")


def uniform_gap(order: Column, rate: float, seed: int = 0) -> Column:
    u = F.conv(F.substring(F.md5(F.concat(order.cast("string"), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("double") / float(16**12)
    return u * 2 / rate
