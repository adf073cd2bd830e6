"""Exact top-k search by vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below this, sums of products are exact in double precision.
EXACT = 2**53
#: And below this in single precision.
EXACT_SINGLE = 2**24
#: Strips of vectors, at most; each returns k rows a query.
STRIPS = 64
#: Blocks of queries that a task takes through its strip.
RUN = 16


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or empty or holds a component that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")))


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type of 16, 32 or 64 bits that holds them."""
    lo, hi = values.min(initial=0), values.max(initial=0)
    return values.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def unpacked(ids: bytes, values: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    ids, values = np.frombuffer(ids, "<i8"), np.frombuffer(values, f"<i{bits // 8}")
    return ids, values.reshape(len(ids), len(values) // len(ids))


def blocks(vectors: DataFrame, name: str, rows: int, total: int) -> DataFrame:
    """Rows (dim, name, ids, values, bits): blocks of about `rows` vectors of one dimension, by id, packed as little-endian integers of so many bits."""
    n = max(1, -(-total // rows))
    dealt = vectors.withColumn("dim", F.size("v")).withColumn(name, F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        ids = np.asarray(t.column("id")).astype("<i8")
        order = np.argsort(ids, kind="stable")
        v = narrow(np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(ids), t.column("dim")[0].as_py())[order])
        return pa.table({
            "dim": pa.array([t.column("dim")[0].as_py()], pa.int32()), name: pa.array([t.column(name)[0].as_py()], pa.int32()),
            "ids": pa.array([ids[order].tobytes()], pa.binary()), "values": pa.array([v.tobytes()], pa.binary()), "bits": pa.array([8 * v.itemsize], pa.int32()),
        })

    return dealt.groupBy("dim", name).applyInArrow(pack, f"dim int, {name} int, ids binary, values binary, bits int")


def scan(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, cell_bits: int) -> list[tuple]:
    """The k best rows of a block for each query, ties to the smaller id.

    The approximation keeps the high bits of each component. A cell's width being the same in every dimension, the
    upper bound of the inner product is that with the cell's corner plus (width - 1) times the query's positive part.
    Exact vectors are read in order of that bound until the k-th best score is above the next bound.
    """
    width = 1 << cell_bits
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0) + width) * q.shape[1]
    kind = np.float64 if largest < EXACT else object
    q, x = q.astype(kind), x.astype(kind)
    cells = x // width * width
    bounds = q @ cells.T + (width - 1) * np.where(q > 0, q, 0).sum(axis=1)[:, None]
    out = []
    for i, row in enumerate(bounds):
        own = x_ids != q_ids[i]
        best: list[tuple[int, int]] = []
        left, step = np.flatnonzero(own), max(4 * k, 32)
        while len(left):
            if len(left) > step:
                top = np.argpartition(-row[left], step)[: step + 1] if kind is np.float64 else np.argsort(-row[left], kind="stable")[: step + 1]
                now = np.zeros(len(left), bool)
                now[top] = True
            else:
                now = np.ones(len(left), bool)
            read, left = left[now], left[~now]
            scores = x[read] @ q[i]
            order = np.lexsort((x_ids[read], -scores))[:k] if kind is np.float64 else sorted(range(len(read)), key=lambda j: (-scores[j], x_ids[read[j]]))[:k]
            best = sorted(best + [(-int(scores[j]), int(x_ids[read[j]])) for j in order])[:k]
            if len(best) == k:  # what could still tie or win
                left = left[row[left] >= -best[-1][0]]
            step *= 4
        out += [(int(q_ids[i]), vid, -score) for score, vid in best]
    return out


#: Queries whose bounds are computed at once.
SLICE = 256
#: A place of a best list that is still free.
FREE_SCORE, FREE_ID = -(2**63 - 1), 2**63 - 1


class Best:
    """The k best (score, id) that each of some queries has met so far, in order; ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.scores = np.full((len(q_ids), k), FREE_SCORE, np.int64)
        self.ids = np.full((len(q_ids), k), FREE_ID, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of the queries in these rows."""
        k, some = self.k, np.unique(rows)
        row = np.concatenate([np.repeat(some, k), rows])
        score = np.concatenate([self.scores[some].ravel(), scores.astype(np.int64)])
        vid = np.concatenate([self.ids[some].ravel(), ids])
        order = np.lexsort((vid, -score, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.scores[some], self.ids[some] = score[order].reshape(-1, k), vid[order].reshape(-1, k)

    def meet(self, q: np.ndarray, x: np.ndarray, x_ids: np.ndarray, cell_bits: int) -> None:
        """Takes in a block of vectors, in order of id: the bounds are `scan`'s, and only vectors whose bound reaches a query's k-th best score are read."""
        k, width = self.k, 1 << cell_bits
        largest = float(np.abs(q.astype(np.float64)).max(initial=0)) * (float(np.abs(x.astype(np.float64)).max(initial=0)) + width) * q.shape[1]
        if largest >= EXACT:
            for i in range(len(q)):
                if found := scan(q[i : i + 1].astype(np.int64), self.q_ids[i : i + 1], x.astype(np.int64), x_ids, k, cell_bits):
                    self.add(np.full(len(found), i), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64))
            return
        kind = np.float32 if largest < EXACT_SINGLE else np.float64
        cells = (x // width * width).astype(kind).T
        q, x = q.astype(kind), x.astype(kind)
        slack = (width - 1) * np.where(q > 0, q, 0).sum(axis=1)
        lo, hi = np.searchsorted(x_ids, self.q_ids, "left"), np.searchsorted(x_ids, self.q_ids, "right")
        for at in range(0, len(q), SLICE):
            part = q[at : at + SLICE]
            bounds = part @ cells + slack[at : at + SLICE, None]
            for i in np.flatnonzero(lo[at : at + SLICE] < hi[at : at + SLICE]):
                bounds[i, lo[at + i] : hi[at + i]] = np.nan  # the query's own rows
            last, last_id = self.scores[at : at + SLICE, -1], self.ids[at : at + SLICE, -1]
            least = np.where(last == FREE_SCORE, -np.inf, last.astype(np.float64)).astype(kind)
            new, step = np.flatnonzero(last == FREE_SCORE), max(4 * k, 32)
            if len(new) and len(x) > step:  # a first k-th best, of those of the highest bounds
                top = np.argpartition(-bounds[new], step, axis=1)[:, :step]
                scores = np.einsum("id,ijd->ij", part[new], x[top])
                scores[np.isnan(np.take_along_axis(bounds[new], top, axis=1))] = -np.inf
                least[new] = np.partition(scores, step - k, axis=1)[:, step - k]
            read = bounds >= least[:, None]
            if 32 * np.count_nonzero(read) > read.size:  # so many that one product for all is less work
                exact = part @ x.T
                read &= exact >= least[:, None]
                row, col = np.divmod(np.flatnonzero(read), len(x))
                scores = exact[row, col]
            else:
                row, col = np.divmod(np.flatnonzero(read), len(x))
                scores = np.einsum("id,id->i", part[row], x[col])
            kept = (scores > least[row]) | ((scores == least[row]) & (x_ids[col] < last_id[row]))
            if kept.any():
                self.add(at + row[kept], x_ids[col[kept]], scores[kept])

    def rows(self) -> pa.RecordBatch:
        full = self.scores != FREE_SCORE
        named = np.broadcast_to(self.q_ids[:, None], full.shape)
        return pa.RecordBatch.from_arrays([pa.array(c[full]) for c in (named, self.ids, self.scores)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, cell_bits: int = 4, query_block: int = 4096, vector_block: int = 4096) -> DataFrame:
    """The k vectors of largest integer inner product for each query: (query_id, rank, vec_id, score).

    Both tables have (id, v), v an array of longs or null. Nulls take no part, nor do rows of the query's own id or of
    another dimension; equal rows of one id count once, ids with several vectors as one candidate each. Fewer than k
    candidates: all of them. Ties go to the smaller id. Vectors are dealt into STRIPS strips at most, queries into runs
    of RUN blocks; each strip meets each run in one task, which reads both block by block, so no block is copied for
    those that it meets, and returns the k best of its strip for each query; those are merged for each query.
    """
    vectors = vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    queries = queries.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    n_x, n_q = vectors.count(), queries.count()
    x = blocks(vectors.distinct(), "block", vector_block, n_x).repartition(max(1, min(STRIPS, -(-n_x // vector_block))))
    q = blocks(queries.distinct(), "query_block", query_block, n_q).repartition(max(1, -(-n_q // (RUN * query_block))))
    q = q.select(F.col("dim").alias("q_dim"), "query_block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "values", "bits")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], Best] = {}
        for b in batches:
            for r in b.to_pylist():
                x_ids, x = unpacked(r["ids"], r["values"], r["bits"])
                q_ids, q = unpacked(r["q_ids"], r["q_values"], r["q_bits"])
                at = (r["q_dim"], r["query_block"])
                if at not in best:
                    best[at] = Best(q_ids, k)
                best[at].meet(q, x, x_ids, cell_bits)
        for one in best.values():
            yield one.rows()

    pairs = x.join(q.hint("shuffle_replicate_nl"), F.col("dim") == F.col("q_dim")).select("ids", "values", "bits", "q_dim", "query_block", "q_ids", "q_values", "q_bits")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
"""
