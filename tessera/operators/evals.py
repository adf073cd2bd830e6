"""Evaluation statistics: accuracies, votes, errors, pass@k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(ok: Column) -> Column:
    return F.avg(ok.cast("int"))


def by_group(df: DataFrame, groups: list[str], ok: Column) -> DataFrame:
    """Accuracy and rows of each group, of each prefix of the groups, and overall (nulls)."""
    return df.rollup(*groups).agg(accuracy(ok).alias("accuracy"), F.count("*").alias("n"))


def macro_micro(df: DataFrame, group: str, ok: Column) -> DataFrame:
    each = df.groupBy(group).agg(F.sum(ok.cast("int")).alias("right"), F.count("*").alias("n"))
    return each.agg(F.avg(F.col("right") / F.col("n")).alias("macro"), (F.sum("right") / F.sum("n")).alias("micro"))


def metric_table(df: DataFrame, metrics: str) -> DataFrame:
    """Mean and population deviation of each named metric of a map column."""
    return df.select(F.explode(metrics).alias("name", "value")).groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def standard_error(df: DataFrame, question: str, score: Column) -> DataFrame:
    """Mean accuracy and the mean over questions of the sample deviation over the root of the tries."""
    each = df.groupBy(question).agg(F.avg(score).alias("m"), (F.stddev_samp(score) / F.sqrt(F.count("*"))).alias("se"))
    return each.agg(F.avg("m").alias("accuracy"), F.avg("se").alias("standard_error"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product; null where k > n."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (F.lit(1.0) - k / i))
    return F.when(n < k, None).when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - product)


def majority(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The most frequent value of each group, the first seen on ties."""
    votes = df.groupBy(group, value).agg(F.count("*").alias("votes"), F.min(order).alias("seen"))
    w = Window.partitionBy(group).orderBy(F.desc("votes"), "seen")
    return votes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(group, value, "votes")


def positional(values: Column, share: float) -> Column:
    """The value at place int(share * n) of the sorted list, from 0."""
    s = F.array_sort(values)
    return F.element_at(s, F.floor(F.size(s) * share).cast("int") + 1)
