"""Exact and near duplicates, with the first of a stated order winning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.shared import checkpointed


def first_wins(df: DataFrame, key: Column, *order) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_key", "_rn")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier output doesn't hold."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def simhash(df: DataFrame, id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, sig) and the columns to keep: 64-bit simhash of lower-cased words, each by the low 64 bits of its MD5; ties and empty texts give ones.

    A row's signature needs its own text alone, so nothing is shuffled: an Arrow function hashes the distinct words of
    a batch once and sums their votes as a product of matrices.
    """

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            out = np.empty(len(b), np.int64)
            for at, words in enumerate(b["words"]):
                if len(known) > 200_000:
                    known.clear()
                h = np.array([known.get(w) or known.setdefault(w, int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big")) for w in (() if words is None else words)], np.uint64)
                ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[at] = np.packbits(2 * ones >= len(h), bitorder="little").view(np.int64)[0]
            yield pd.DataFrame({c: b[c] for c in (id, *keep)} | {"sig": out})

    words = df.select(id, *keep, tx.tokens(F.col(text)).alias("words"))
    return words.mapInPandas(signatures, ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in (id, *keep)) + ", sig long")


def bands(sigs: DataFrame, most: int = 3) -> DataFrame:
    """Adds a row for each two of `most` + 2 parts of a signature: signatures that differ in at most `most` bits are equal in two parts at least.

    Two parts are 25 of the 64 bits, by default, so a bucket holds few others even in a large corpus.
    """
    n = most + 2
    edges = [64 * k // n for k in range(n + 1)]
    part = lambda k: F.shiftrightunsigned("sig", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    keys = [F.struct(F.lit(i * n + j).alias("band"), F.shiftleft(part(i), 32).bitwiseOR(part(j)).alias("v")) for j in range(n) for i in range(j)]
    return sigs.withColumn("k", F.explode(F.array(*keys))).select(*sigs.columns, "k.band", "k.v")


def near_kinds(sigs: DataFrame, group: tuple[str, ...] = (), most: int = 3) -> DataFrame:
    """(group, sig_a, sig_b): distinct signatures, sig_a < sig_b, that differ in at most `most` bits."""
    kinds = bands(sigs.select(*group, "sig").distinct(), most)
    x, y = kinds.withColumnRenamed("sig", "sig_a"), kinds.withColumnRenamed("sig", "sig_b")
    close = (F.col("sig_a") < F.col("sig_b")) & (tx.hamming(F.col("sig_a"), F.col("sig_b")) <= most)
    return x.join(y, [*group, "band", "v"]).where(close).select(*group, "sig_a", "sig_b").distinct()


def near_pairs(sigs: DataFrame, id: str = "doc_id", group: tuple[str, ...] = (), most: int = 3) -> DataFrame:
    """(a, b): a < b whose signatures differ in at most `most` bits. Distinct signatures are met first, then their ids.

    `sigs` is read several times: cut its lineage if it is dear.
    """
    met = near_kinds(sigs, group, most)
    both = met.union(met.select(*group, F.col("sig_b").alias("sig_a"), F.col("sig_a").alias("sig_b")))
    both = both.union(sigs.select(*group, F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b")).distinct())
    named = lambda s, as_: sigs.select(*group, F.col("sig").alias(s), F.col(id).alias(as_))
    return both.join(named("sig_a", "a"), [*group, "sig_a"]).join(named("sig_b", "b"), [*group, "sig_b"]).where("a < b").select("a", "b").distinct()


def near_survivors(sigs: DataFrame, id: str = "doc_id", group: tuple[str, ...] = (), most: int = 3) -> DataFrame:
    """Ids that a greedy pass in id order keeps: an id goes if a kept smaller one's signature, in its group, differs in at most `most` bits.

    Of the ids of one signature only the least can stay: what beats it is smaller than the others and beats them too.
    So only the least ids of signatures meet, however many copies there are.
    """
    # rows whose group holds a null meet nobody
    alone = F.when(F.array_contains(F.array(F.lit(False), *[F.col(g).isNull() for g in group]), True), F.col(id))
    firsts = checkpointed(sigs.groupBy(*group, "sig", alone.alias("_alone")).agg(F.min(id).alias(id)).drop("_alone"))
    named = lambda s, as_: firsts.select(*group, F.col("sig").alias(s), F.col(id).alias(as_))
    met = near_kinds(firsts, group, most).join(named("sig_a", "x"), [*group, "sig_a"]).join(named("sig_b", "y"), [*group, "sig_b"])
    return greedy_survivors(firsts.select(id), met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), id)


def greedy_survivors(ids: DataFrame, pairs: DataFrame, id: str = "doc_id", rounds: int = 1000) -> DataFrame:
    """Ids that a greedy pass in id order keeps: an id goes if a smaller kept one is paired with it.

    Each round settles every id all of whose smaller neighbours are settled, so the number of rounds is the longest
    chain, and each is one join. Lineage is cut by checkpoints in the shared folder.
    """
    # ids without smaller neighbours are kept at once
    state = ids.select(F.col(id).alias("v")).distinct().join(pairs.select(F.col("b").alias("v")).distinct().withColumn("open", F.lit(True)), "v", "left")
    state = state.select("v", F.when(F.col("open"), F.lit(0)).otherwise(F.lit(1)).alias("s"))
    state, pairs = checkpointed(state), checkpointed(pairs)
    for _ in range(rounds):
        seen = pairs.join(state.withColumnRenamed("v", "a"), "a").groupBy("b").agg(F.max(F.col("s") == 1).alias("beaten"), F.max(F.col("s") == 0).alias("waits"))
        joined = state.join(seen.withColumnRenamed("b", "v"), "v", "left")
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("beaten"), 2).when(~F.col("waits"), 1).otherwise(0)
        state = checkpointed(joined.select("v", new.alias("s")))
        if state.where("s = 0").isEmpty():
            return state.where("s = 1").select(F.col("v").alias(id))
    raise RuntimeError(f"unsettled after {rounds} rounds")
