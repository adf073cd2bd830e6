"""What the operators share: scratch tables in the cluster's checkpoint folder, word counts and salted prefix sums."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where that is unset (local runs and tests)."""
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage. They go when the session ends, or when dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self, *tables: DataFrame) -> None:
        """Removes these tables; and Spark's cleaner removes shuffle files of finished queries, which wait for the driver to collect its garbage."""
        if tables:
            self.drop(*tables)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Removes these tables, or all."""
        try:
            jvm = self.spark.sparkContext._jvm
            paths = [self.base] if not tables else [f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()[:1]]
            for p in paths:
                at = jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended; nothing depends on the removal
            pass


def fresh(df: DataFrame, n: int) -> list[str]:
    """So many column names that a frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [f"tessera_{k}" for k in range(len(taken) + n) if f"tessera_{k}" not in taken][:n]


def word_count(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before this one in its group, by bucket and then `order`.

    `bucket` splits a group into ranges that one task can sort, so a hot group spreads over many tasks; only one
    row a bucket meets the others of its group.
    """
    from pyspark.sql import Window

    key = [*group, bucket]
    by_group = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*key).agg(F.sum(value).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(by_group), F.lit(0)))
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_start")
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return inner.join(starts, same, "left").withColumn(name, F.col("_in") + F.col("_start")).drop("_in", "_start", *[f"_k{i}" for i in range(len(key))])
