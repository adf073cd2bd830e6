"""Quota mixing: allocation, seeded samples, fill, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(sizes: dict[str, int], weights: dict[str, float], total: int) -> dict[str, int]:
    """Rows from each source: the rounded share (half to even), at most its size; then one row each in turn while any source has more and the total isn't met.

    Rounding may give more than the total; that isn't taken back. Weights of zero share nothing.
    """
    whole = sum(weights.get(s, 0) for s in sizes)
    out = {s: min(n, round(total * weights.get(s, 0) / whole)) if whole else 0 for s, n in sizes.items()}
    short = total - sum(out.values())
    while short > 0 and (open_ := [s for s, n in sizes.items() if out[s] < n]):
        for s in open_:
            if short <= 0:
                break
            out[s] += 1
            short -= 1
    return out


def draw(key: Column, seed: int) -> Column:
    """A row's place in a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample(df: DataFrame, quota: dict[str, int], source: str, key: Column, seed: int = 42) -> DataFrame:
    """The first quota[source] rows of each source in shuffled order."""
    w = Window.partitionBy(source).orderBy(draw(key, seed), key)
    most = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.coalesce(F.element_at(most, F.col(source)), F.lit(0))).drop("_rn")


def fill(picked: DataFrame, pool: DataFrame, key: str, total: int, seed: int = 42, redraw: bool = False) -> DataFrame:
    """Rows of the pool that bring a mix up to its total: those not picked yet or, with `redraw`, any of them again."""
    need = max(0, total - picked.count())
    left = pool if redraw else pool.join(picked.select(key).distinct(), key, "left_anti")
    return picked.unionByName(left.orderBy(draw(F.col(key), seed), key).limit(need))


def summary(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"))
