"""A corpus from ranked sources: filter, exact and near duplicates, quotas, shuffle, fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import dedup, mix
from tessera.operators.shared import checkpointed


def curated(
    rows: DataFrame, weights: dict[str, float], total: int, ok: Column, seen: DataFrame | None = None, filtering: bool = True, deduplicating: bool = True, near: int | None = 3, seed: int = 42
) -> DataFrame:
    """Rows (id, source, rank, text) of a corpus of `total` rows, as far as there are so many; columns id, source, fp.

    With `filtering`, rows that aren't `ok` go, and then all but the first of a text in order of rank and id; without,
    only empty texts go, and repeated ones stay until the end. With `deduplicating`, near duplicates (signatures that
    differ in at most `near` bits; None: not looked for) of a source's earlier rows go before the quotas, and repeated
    texts of the shuffled corpus after them, `seen` ones too; the corpus is then filled with texts that it doesn't have.
    Without, it is filled by drawing from all rows again.
    """
    pool = rows.withColumn("fp", F.md5("text")).where(F.length(F.coalesce("text", F.lit(""))) > 0)
    if seen is not None and filtering:
        pool = dedup.unseen(pool, seen, "fp")
    if filtering:
        pool = dedup.first_wins(pool.where(ok), F.col("fp"), "rank", "id")
    if deduplicating and near is not None:
        sigs = checkpointed(dedup.simhash(pool, "id", "text").join(pool.select("id", "source"), "id"))
        kept = dedup.near_survivors(sigs, "id", ("source",), near)
        pool = pool.join(kept, "id", "left_semi")
    pool = checkpointed(pool.select("id", "source", "fp"))
    sizes = {r["source"]: r["n"] for r in mix.summary(pool, "source").orderBy("source").collect()}
    picked = mix.sample(pool, mix.allocate(sizes, weights, total), "source", F.concat_ws("|", "fp", F.col("id").cast("string")), seed)
    if deduplicating:
        picked = dedup.first_wins(picked, F.col("fp"), mix.draw(F.col("fp"), seed), "id")
        picked = dedup.unseen(picked, seen, "fp") if seen is not None else picked
        first = dedup.first_wins(pool, F.col("fp"), "id")
        return mix.fill(picked, dedup.unseen(first, seen, "fp") if seen is not None else first, "fp", total, seed)
    return mix.fill(picked, pool, "fp", total, seed, redraw=True)
