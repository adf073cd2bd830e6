"""Global row numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.shared import checkpointed


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows ranged over partitions in order, with the partition's number as _part; written once, so that all that is counted from them agrees."""
    return checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds contiguous numbers in a total order: rows are ranged over partitions and sorted, and one count a partition is summed up."""
    ranged = _ranged(df, order)
    ranged = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_at") + F.col("_start") - 1 + start).cast("long")).drop("_part", "_at", "_start")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds a running sum in a total order, the same way: one sum a partition is carried on."""
    ranged = _ranged(df, order)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumn("_in", F.sum(value).over(upto))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_in") + F.col("_start")).drop("_part", "_in", "_start")
