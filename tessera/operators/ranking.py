"""Top-k, nucleus filters, penalties, prefix matches, packing, routing."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import numbered


def top_k(df: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Strips of vectors, at most, and vectors of one at least; each strip returns k rows a query.
STRIPS, STRIP = 64, 2048
#: Queries that a task holds, and those whose scores it computes at once.
RUN, SLICE = 65_536, 256
#: Scores of a free place of a list of the best and of a pair without a score.
FREE, NO_SCORE = -(2**63), -(2**63) + 1


def _matrix(rows: pa.ChunkedArray | pa.ListArray) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as a matrix, zero where there is no component; and which are there, or None if all are."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = rows.flatten()
    if len(sizes) and not flat.null_count and (sizes == sizes[0]).all():
        return flat.to_numpy(zero_copy_only=False).reshape(len(sizes), sizes[0]), None
    out, there = np.zeros((len(sizes), sizes.max(initial=0))), np.zeros((len(sizes), sizes.max(initial=0)), bool)
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there[at] = flat.is_valid().to_numpy(zero_copy_only=False)
    out[at] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    return out, there


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of round(a * b * 1e6) over the components, which have three decimals."""
    a, b = np.rint(q * 1000), np.rint(x * 1000)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    # each rounded product is that of two whole numbers, and their sums are exact
    if most < 2**45 and most * a.shape[1] < 2**53:
        kind = np.float32 if most * a.shape[1] < 2**24 else np.float64
        return a.astype(kind) @ b.astype(kind).T
    out = np.empty((len(q), len(x)), np.int64)
    for i, row in enumerate(q):
        p = row * x * 1e6
        if not (np.abs(p).sum(axis=1) < 2**62).all():
            raise OverflowError("a score is beyond 64 bits")
        out[i] = np.copysign(np.floor(np.abs(p) + (np.abs(p) < 2**52) * 0.5), p).astype(np.int64).sum(axis=1)
    return out


class _Best:
    """The k best (score, id) that each query has met so far, in order; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: tuple[np.ndarray, np.ndarray | None], k: int):
        self.q_ids, (self.q, self.there), self.k = ids, vectors, k
        self.scores, self.ids = np.full((len(ids), k), FREE), np.full((len(ids), k), 2**63 - 1)

    def meet(self, x_ids: np.ndarray, x: np.ndarray, there: np.ndarray | None) -> None:
        """Takes in vectors; those of smaller ids are best met first."""
        dim = min(self.q.shape[1], x.shape[1])
        whole = self.there is None and there is None and self.q.shape[1] == x.shape[1] > 0
        for at in range(0, len(self.q_ids), SLICE):
            rows = slice(at, at + SLICE)
            s = _dots(self.q[rows, :dim], x[:, :dim])
            own = self.q_ids[rows, None] == x_ids
            least, last_id = self.scores[rows, -1], self.ids[rows, -1]
            if not whole:
                has = [np.ones(v.shape, np.float32) if m is None else m.astype(np.float32) for v, m in ((self.q[rows], None if self.there is None else self.there[rows]), (x, there))]
                none = (has[0][:, :dim] @ has[1][:, :dim].T) == 0
                s = np.where(none, NO_SCORE, s.astype(np.int64))
            elif s.dtype != np.int64:
                least = np.where(least <= NO_SCORE, -np.inf, least.astype(np.float64)).astype(s.dtype)
            kept = ((s > least[:, None]) | ((s == least[:, None]) & (x_ids < last_id[:, None]))) & ~own
            row, col = np.nonzero(kept)
            if len(row):
                self._add(at + row, x_ids[col], s[row, col].astype(np.int64))

    def _add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        some = np.unique(row)
        row = np.concatenate([np.repeat(some, self.k), row])
        scores, ids = np.concatenate([self.scores[some].ravel(), scores]), np.concatenate([self.ids[some].ravel(), ids])
        order = np.lexsort((ids, ~scores, row))  # ~ turns the order without leaving 64 bits
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.scores[some], self.ids[some] = scores[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        full = self.scores != FREE
        scores = self.scores[full]
        named = np.broadcast_to(self.q_ids[:, None], full.shape)[full]
        return pa.RecordBatch.from_arrays([pa.array(named), pa.array(self.ids[full]), pa.array(scores, mask=scores == NO_SCORE)], ["query_id", "vec_id", "score"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): for each query the k rows of another id with the largest scores, ties to the smaller id.

    Both have (id, e), e being doubles of three decimals. The score sums round(a * b * 1e6) over the components that
    both have; it is null, which comes last, if there are none. Every query meets every vector: vectors are dealt into
    strips and queries into runs, each strip is sorted and streamed past a run in one task, and the k best of a strip
    for each query are merged. So a task holds a run and a batch, and returns no more than k rows a query.
    """
    vectors = vectors.where("id IS NOT NULL").select("id", "e")
    queries = queries.where("id IS NOT NULL").select("id", "e")
    strips = min(STRIPS, vectors.count() // STRIP + 1)
    runs = queries.count() // RUN + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.select("*", F.lit(False).alias("met"), each(strips).alias("strip"), deal(runs).alias("run"))
    x = vectors.select("*", F.lit(True).alias("met"), deal(strips).alias("strip")).select("*", each(runs).alias("run"))
    dealt = q.union(x.select(q.columns)).repartition(strips * runs, "strip", "run").sortWithinPartitions("strip", "run", "met", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, best = None, [], None
        for b in batches:
            place = np.stack([np.asarray(b.column(c).cast(pa.int32())) for c in ("strip", "run", "met")])
            edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if (now := tuple(place[:2, lo])) != at:
                    if best is not None:
                        yield best.rows()
                    at, held, best = now, [], None
                if not place[2, lo]:
                    held.append(part.select(["id", "e"]))
                    continue
                if best is None and not held:
                    continue
                if best is None:
                    t = pa.Table.from_batches(held)
                    best, held = _Best(np.asarray(t.column("id")), _matrix(t.column("e")), k), []
                ids, (v, there) = np.asarray(part.column("id")), _matrix(part.column("e"))
                # the first few tell which of the others are worth a look
                few = min(len(ids), 128)
                for some in (slice(0, few), slice(few, None)):
                    if len(ids[some]):
                        best.meet(ids[some], v[some], None if there is None else there[some])
        if best is not None:
            yield best.rows()

    return top_k(dealt.mapInArrow(search, "query_id long, vec_id long, score long"), "query_id", "score", k, "vec_id")


def nucleus(df: DataFrame, group: str, p: str, tie: str, top_k: int, top_p: float, min_p: float) -> DataFrame:
    """Rows of each distribution within top_k, within top_p of the mass before them, and min_p of the largest; `kept_p` sums to 1."""
    w = Window.partitionBy(group).orderBy(F.desc(p), tie)
    df = df.withColumn("rank", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("_max", F.max(p).over(Window.partitionBy(group)))
    df = df.where((F.col("rank") <= top_k) & (F.col("_before") <= top_p) & (F.col(p) >= F.col("_max") * min_p))
    return df.withColumn("kept_p", F.col(p) / F.sum(p).over(Window.partitionBy(group))).drop("_before", "_max")


def penalised(logit: Column, count: Column, frequency: float, presence: float, stop: Column, length: Column, min_new: int) -> Column:
    """Less frequency times count, less presence once, and minus infinity for stop tokens before min_new tokens."""
    seen = F.coalesce(count, F.lit(0))
    lowered = logit - frequency * seen - F.when(seen > 0, presence).otherwise(0.0)
    return F.when(stop & (length < min_new), F.lit(float("-inf"))).otherwise(lowered)


def longest_prefix(queries: DataFrame, stored: DataFrame, id: str, key: str, page: int = 1) -> DataFrame:
    """(id, matched, stored_id): the stored key that shares the longest prefix, in whole pages; ties to the smaller id.

    Both sides become rows of page-aligned prefixes, met by equality of hash and length, so no pair of keys is compared
    that shares no page. A stored prefix is kept once. A prefix's 128-bit hash is chained from its pages' hashes, so a
    key is read once, whatever its length.
    """

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, places, hashes = [], [], []
            for i, text in zip(b[id], b[key]):
                h = hashlib.blake2b(digest_size=16)
                for k in range(len(text) // page):
                    h.update(text[k * page : (k + 1) * page].encode("utf-8", "surrogatepass"))
                    ids.append(i)
                    places.append(k + 1)
                    hashes.append(h.digest())
            yield pd.DataFrame({id: ids, "k": places, "h": hashes})

    def prefixes(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[id]
        return df.where(F.length(key) >= page).select(id, key).mapInPandas(chained, f"`{id}` {kind}, k int, h binary")

    kept = prefixes(stored).groupBy("k", "h").agg(F.min(id).alias("stored_id"))
    found = prefixes(queries).join(kept, ["k", "h"]).groupBy(id).agg(F.max(F.struct(F.col("k"), (-F.col("stored_id")).alias("s"))).alias("b"))
    return queries.select(id).join(found, id, "left").select(id, F.coalesce(F.col("b.k") * page, F.lit(0)).cast("long").alias("matched"), (-F.col("b.s")).alias("stored_id"))


def schedule_order(df: DataFrame, matched: str, tie: str, queue_limit: int = 128, deprioritised: Column | None = None) -> DataFrame:
    """Longest match first, deprioritised ones last; first come first served if the queue is longer than the limit."""
    late = deprioritised if deprioritised is not None else F.lit(False)
    if df.count() > queue_limit:
        return numbered(df, [tie], "place", start=1)
    keyed = df.withColumn("_late", late.cast("int")).withColumn("_less", -F.col(matched))
    return numbered(keyed, ["_late", "_less", tie], "place", start=1).drop("_late", "_less")


def balanced_packs(df: DataFrame, layer: str, item: str, weight: str, packs: int) -> DataFrame:
    """Heaviest item first into the lightest pack that isn't full; each pack gets as many items. A layer's items are a bounded list, handled in one task."""
    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values([weight, item], ascending=[False, True])
        room, out = -(-len(t) // packs), []
        open_ = [(0.0, p, 0) for p in range(packs)]  # load, pack, items
        for w in t[weight]:
            load, p, n = heapq.heappop(open_)
            out.append((p, n))
            if n + 1 < room:
                heapq.heappush(open_, (load + w, p, n + 1))
        return t.assign(pack=[k for k, _ in out], place=[p for _, p in out])

    return df.groupBy(layer).applyInPandas(pack, df.schema.simpleString()[7:-1].replace(":", " ") + ", pack int, place int")


def replicated(df: DataFrame, layer: str, item: str, weight: str, extra: int) -> DataFrame:
    """Gives `extra` more replicas, each to the item with the largest load per replica: (layer, item, weight, replicas)."""
    def give(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(item)
        n = [1] * len(t)
        w = t[weight].tolist()
        for _ in range(extra):
            k = max(range(len(w)), key=lambda i: (w[i] / n[i], -i))
            n[k] += 1
        return t.assign(replicas=n)

    return df.groupBy(layer).applyInPandas(give, df.schema.simpleString()[7:-1].replace(":", " ") + ", replicas int")


def cache_aware_route(match_rate: Column, matched: Column, least_loaded: Column, smallest: Column, low: Column, high: Column, threshold: float = 0.5, abs_gap: float = 32, rel_gap: float = 1.0001) -> Column:
    """The least loaded worker if loads are out of balance, else the matched one above a match rate, else that with the smallest cache."""
    uneven = ((high - low) > abs_gap) & (high > rel_gap * low)
    return F.when(uneven, least_loaded).when(match_rate > threshold, matched).otherwise(smallest)


def two_choices(load_a: Column, load_b: Column, a: Column, b: Column) -> Column:
    return F.when(load_a <= load_b, a).otherwise(b)


def subtree_order(df: DataFrame, id: str, path: str, name: str) -> DataFrame:
    """(id, name): a place, from 0, for each node of a tree, its path being an array of labels from the root down.

    The order goes depth first, a node after all below it; of the branches at a node the one of most rows first, then
    the one of the least label; rows of one node by id. A null or empty path is the root, which comes last.
    """
    rows = df.select(F.col(id).alias("id"), F.coalesce(path, F.array().cast("array<string>")).alias("path"))
    # each row counts for every node on its path
    on = rows.select("id", "path", F.posexplode("path").alias("depth", "label")).withColumn("node", F.slice("path", F.lit(1), F.col("depth") + 1))
    lead = on.groupBy("node").agg((-F.count("*")).alias("lead"))
    step = F.struct("depth", "lead", F.coalesce("label", F.lit("")).alias("label"))
    keys = on.join(lead, "node").groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    # what ends at a node comes after what goes on below it
    end = F.array(F.struct(F.size("path").alias("depth"), F.lit((1 << 63) - 1).alias("lead"), F.lit("").alias("label")))
    keyed = rows.join(keys, "id", "left").select("id", F.when(F.col("steps").isNull(), end).otherwise(F.concat("steps", end)).alias("key"))
    return numbered(keyed, ["key", "id"], name).select(F.col("id").alias(id), name)
