"""Copies among images: multiscale corners, orientation-normalised binary tests, Hamming tables and geometric consensus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch
from tessera.llm.components import components

#: Scales of the pyramid and corners kept at each in an image of AREA pixels or less; more in proportion in larger ones.
SCALES = ((1.0, 16), (0.7071, 8), (0.5, 6))
RADIUS = 7
ANGLES = 32
BITS = 128
#: Keys of 32 bits each, so descriptors that differ in up to 3 bits always share one.
TABLES = 4
AREA = 64 * 64
#: Features of a block of a bucket; all pairs of two blocks meet in one task.
BLOCK = 1024
#: Comparisons of features at once, about: so many like pairs at most are on disk together.
COMPARED = 1 << 26


def to_pgm(image: np.ndarray) -> bytes:
    """A grey image (rows, columns; uint8) as binary PGM."""
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    """The image, or None if the bytes aren't a whole binary PGM of 8 bits."""
    if not data or not data.startswith(b"P5"):
        return None
    head, at = [], 2
    while len(head) < 3 and at < len(data):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) % (len(data) + 1)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        head.append(int(data[at:end]))
        at = end
    if len(head) < 3 or head[2] > 255 or head[0] * head[1] != len(data) - at - 1:
        return None
    return np.frombuffer(data, np.uint8, offset=at + 1).reshape(head[1], head[0])


def _pattern() -> np.ndarray:
    """(angle, test, two ends, row and column): random pairs within the radius, turned to each angle."""
    rng = np.random.default_rng(20)
    ends = rng.normal(0, RADIUS / 2.2, (4 * BITS, 2, 2))
    ends = ends[(np.hypot(ends[..., 0], ends[..., 1]) < RADIUS - 0.5).all(1) & (np.abs(ends[:, 0] - ends[:, 1]).sum(1) > 2)][:BITS]
    a = np.arange(ANGLES) * (2 * np.pi / ANGLES)
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], 1), np.stack([-np.sin(a), np.cos(a)], 1)], 1)  # row' = row cos + col sin
    return np.rint(np.einsum("aij,tej->atei", turn, ends)).astype(np.int64)


PATTERN = _pattern()
DISC = np.array([(r, c) for r in range(-RADIUS, RADIUS + 1) for c in range(-RADIUS, RADIUS + 1) if r * r + c * c <= RADIUS * RADIUS])


def box(x: np.ndarray, k: int) -> np.ndarray:
    """Means over (2k + 1) squares of the last two axes, edges repeated."""
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (k + 1, k)
        total = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        n = x.shape[axis]
        take = lambda a: np.take(total, np.arange(a, a + n), axis=axis)
        x = (take(2 * k + 1) - take(0)) / (2 * k + 1)
    return x


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resampling of a batch."""

    def weights(n: int) -> np.ndarray:
        m = max(1, int(round(n * scale)))
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), max(0, n - 2))
        w = np.zeros((m, n), np.float32)
        w[np.arange(m), lo] += (1 - (at - lo)).astype(np.float32)
        w[np.arange(m), np.minimum(lo + 1, n - 1)] += (at - lo).astype(np.float32)
        return w

    return weights(x.shape[1]) @ x @ weights(x.shape[2]).T


def describe(images: np.ndarray) -> list[np.ndarray]:
    """Features of a batch of grey images of one size: for each image an array of (row, column, scale level, angle, descriptor as two 64-bit words)."""
    per_image: list[list[np.ndarray]] = [[] for _ in images]
    full = images.astype(np.float32)
    times = max(1.0, images[0].size / AREA) if len(images) else 1.0
    for level, (scale, count) in enumerate(SCALES):
        x = box(full if scale == 1 else resized(box(full, 1), scale), 1)
        rows, cols = x.shape[1:]
        edge = RADIUS + 1
        if min(rows, cols) <= 2 * edge:
            continue
        gr, gc = np.zeros_like(x), np.zeros_like(x)
        gr[:, 1:-1], gc[:, :, 1:-1] = x[:, 2:] - x[:, :-2], x[:, :, 2:] - x[:, :, :-2]
        a, b, c = box(gr * gr, 2), box(gc * gc, 2), box(gr * gc, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        inner = corner[:, edge : rows - edge, edge : cols - edge]
        peak = inner.copy()
        for dr in range(-2, 3):
            for dc in range(-2, 3):
                peak = np.maximum(peak, corner[:, edge + dr : rows - edge + dr, edge + dc : cols - edge + dc])
        flat = np.where((inner >= peak) & (inner > 100.0), inner, -1).reshape(len(x), -1)
        k = min(int(np.ceil(count * times)), flat.shape[1])
        top = np.argpartition(-flat, k - 1, axis=1)[:, :k]
        n, j = np.nonzero(np.take_along_axis(flat, top, 1) > 0)
        if not len(n):
            continue
        place = top[n, j]
        r, q = place // inner.shape[2] + edge, place % inner.shape[2] + edge
        patch = x[n[:, None], r[:, None] + DISC[:, 0], q[:, None] + DISC[:, 1]]
        angle = np.arctan2(patch @ DISC[:, 0].astype(np.float32), patch @ DISC[:, 1].astype(np.float32))
        turn = np.rint(angle * ANGLES / (2 * np.pi)).astype(int) % ANGLES
        ends = PATTERN[turn]
        lit = x[n[:, None, None], r[:, None, None] + ends[..., 0], q[:, None, None] + ends[..., 1]]
        words = np.packbits(lit[..., 0] < lit[..., 1], axis=1).view(">i8").astype(np.int64)
        made = np.column_stack([np.rint(r / scale).astype(np.int64), np.rint(q / scale).astype(np.int64), np.full(len(r), level), turn, words])
        order = np.argsort(n, kind="stable")
        for i, part in zip(*_grouped(n[order], made[order])):
            per_image[i].append(part)
    return [np.concatenate(p) if p else np.zeros((0, 6), np.int64) for p in per_image]


def _grouped(keys: np.ndarray, rows: np.ndarray):
    found, starts = np.unique(keys, return_index=True)
    return found, np.split(rows, starts[1:])


FEATURES = "row int, col int, level int, angle int, d0 long, d1 long"


def features(media: DataFrame, key: str, image: str) -> DataFrame:
    """(key, row, col, level, angle, d0, d1) of every feature of every image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                keys, by_size = b.column(key).to_pylist(), {}
                for i, data in enumerate(b.column(image).to_pylist()):
                    if (x := from_pgm(data)) is not None:
                        by_size.setdefault(x.shape, []).append((keys[i], x))
                for group in by_size.values():
                    found = describe(np.stack([x for _, x in group]))
                    if not (n := [len(f) for f in found]) or not sum(n):
                        continue
                    all_ = np.concatenate(found)
                    ids = np.repeat(np.array([k for k, _ in group], np.int64), n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(all_[:, c].astype(np.int32)) for c in range(4)), pa.array(all_[:, 4]), pa.array(all_[:, 5])], [key, "row", "col", "level", "angle", "d0", "d1"])

    return media.select(key, image).where(F.col(key).isNotNull()).mapInArrow(run, f"`{key}` long, {FEATURES}")


def linked(f: DataFrame, differing: int, agreeing: int, scratch: Scratch) -> DataFrame:
    """The pairs of images (a, b) that features (id, row, col, level, angle, d0, d1) link, but for those within a class that others join."""
    part = lambda w, k: F.shiftrightunsigned(w, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    # a table's number and 32 bits of the descriptor in one long; a feature's place, level and angle in another
    keys = F.array(*[part(F.col(f"d{i // 2}"), i % 2).bitwiseOR(F.lit(i << 32)) for i in range(TABLES)])
    row, col = (F.shiftleft(F.col(c).cast("long"), by) for c, by in (("row", 27), ("col", 7)))
    at = row.bitwiseOR(col).bitwiseOR(F.shiftleft(F.col("level").cast("long"), 5)).bitwiseOR(F.col("angle").cast("long"))
    rows = f.select("id", at.alias("at"), "d0", "d1", F.explode(keys).alias("k"))
    # neighbours in a bucket by descriptor, so that those of few differing bits are often next to each other
    w = Window.partitionBy("k").orderBy("d0", "d1", "id", "at")
    held = F.struct("id", "at", "d0", "d1")
    near = rows.withColumn("head", F.first(held).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag(held).over(w))
    far = lambda x, y: F.bit_count(F.col(f"{x}d0").bitwiseXOR(F.col(f"{y}d0"))) + F.bit_count(F.col(f"{x}d1").bitwiseXOR(F.col(f"{y}d1")))
    # compared where they meet: most features that share a key are far apart
    pairs = near.select("id", "at", "d0", "d1", F.explode(F.array("head", "before")).alias("g")).where(F.col("g").isNotNull() & (F.col("g.id") != F.col("id")) & (far("", "g.") <= differing))
    links = scratch.save(agreed(ordered(pairs, F.col("id"), F.col("at"), F.col("g.id"), F.col("g.at")), agreeing), "links")
    scratch.tidy()
    # what is left: pairs of a bucket whose images are in different classes; its features are dealt into blocks
    roots = scratch.save(components(links, scratch).withColumnRenamed("v", "id"), "roots")
    rows = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rows.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = dealt_at = scratch.save(rows.join(several.select("k", "members"), "k").withColumn("own", F.pmod(F.xxhash64("id", "at"), count).cast("int")), "dealt")
    work = (dealt.agg(F.sum("members").alias("n")).collect()[0]["n"] or 0) / 2
    scratch.tidy()
    # in turns by the larger image, so all that votes for a pair of images is in one
    turns = max(1, int(-(-work // COMPARED)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1))).drop("members")
    x = dealt.select("k", *[F.col(c).alias(f"x_{c}") for c in ("id", "at", "d0", "d1", "root")], F.col("own").alias("i"), F.col("other").alias("j"))
    y = dealt.select("k", *[F.col(c).alias(f"y_{c}") for c in ("id", "at", "d0", "d1", "root")], F.col("other").alias("i"), F.col("own").alias("j"))
    more = links
    for turn in range(turns):
        mine = x.where(F.pmod(F.xxhash64("x_id"), F.lit(turns)) == turn)
        rest = mine.join(y, ["k", "i", "j"]).where((F.col("x_root") != F.col("y_root")) & (F.col("y_id") < F.col("x_id")) & (far("x_", "y_") <= differing))
        more = more.union(scratch.save(agreed(ordered(rest, F.col("x_id"), F.col("x_at"), F.col("y_id"), F.col("y_at")), agreeing), "links"))
        scratch.tidy()
    scratch.drop(dealt_at)
    return more


def ordered(pairs: DataFrame, id: Column, at: Column, id2: Column, at2: Column) -> DataFrame:
    """(a, b, g, f): the smaller image and its feature as a and g, the other as b and f."""
    less = id2 < id
    return pairs.select(F.least(id, id2).alias("a"), F.greatest(id, id2).alias("b"), F.when(less, at2).otherwise(at).alias("g"), F.when(less, at).otherwise(at2).alias("f"))


def agreed(pairs: DataFrame, agreeing: int) -> DataFrame:
    """The pairs of images (a, b) of which `agreeing` distinct features, or more, vote for one shift, turn and scale. pairs: (a, b, g, f), features packed."""
    # two images need `agreeing` features in common before votes are made; one exchange by image pair serves all three steps
    pairs = pairs.repartition("a", "b").dropDuplicates(["a", "b", "f", "g"])
    pairs = pairs.withColumn("common", F.count("*").over(Window.partitionBy("a", "b"))).where(F.col("common") >= agreeing)
    bits = lambda c, by, n: F.shiftright(c, by).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    open_ = lambda c: F.struct(bits(c, 27, 20).alias("row"), bits(c, 7, 20).alias("col"), bits(c, 5, 2).alias("level"), bits(c, 0, 5).alias("angle"))
    pairs = pairs.select("a", "b", open_(F.col("f")).alias("f"), open_(F.col("g")).alias("g"))
    # g's place after the turn and scale that the two features differ by; what remains is the shift
    turn = F.pmod(F.col("f.angle") - F.col("g.angle"), F.lit(ANGLES))
    rad = turn * (2 * np.pi / ANGLES)
    scales = F.array(*[F.lit(float(s)) for s, _ in SCALES])
    ratio = F.element_at(scales, F.col("g.level") + 1) / F.element_at(scales, F.col("f.level") + 1)
    shift_row = F.col("f.row") - ratio * (F.col("g.row") * F.cos(rad) + F.col("g.col") * F.sin(rad))
    shift_col = F.col("f.col") - ratio * (F.col("g.col") * F.cos(rad) - F.col("g.row") * F.sin(rad))
    # cells overlap by half, around the circle too: what a cell's edge divides is together in another
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t")) for a in (0.0, 0.5) for b in (0.0, 0.5) for t in (0, 2)])).alias("grid")
    votes = pairs.select("b", "a", F.struct("f.row", "f.col").alias("f"), turn.alias("turn"), F.round(F.log2(ratio) * 2).alias("zoom"), shift_row.alias("sr"), shift_col.alias("sc"), grid)
    cell = F.floor(F.pmod(F.col("turn") + F.col("grid.t"), F.lit(ANGLES)) / 4)
    votes = votes.groupBy("a", "b", cell, "zoom", "grid", F.floor(F.col("sr") / 8 + F.col("grid.a")), F.floor(F.col("sc") / 8 + F.col("grid.b"))).agg(F.countDistinct("f").alias("n"))
    return votes.where(F.col("n") >= agreeing).select("a", "b").distinct()


def classes(media: DataFrame, key: str = "media_id", image: str = "image", differing: int = 12, agreeing: int = 4) -> DataFrame:
    """(key, n_features, class_id, n_links): images and the class of copies each belongs to, named by its smallest key.

    Images of equal bytes are one. A feature meets, in each of four Hamming tables of 32-bit keys, its bucket's first
    image and the one before it; then all pairs of a bucket whose images are in different classes meet, in blocks. Pairs of features that
    differ in at most `differing` of 128 bits vote for a shift, turn and scale; images with `agreeing` distinct
    features behind one of them are linked, and links form classes. Null images and bytes that aren't a binary PGM
    have no features and, but for equal bytes, are classes of their own. Keys are longs; rows of one key and bytes
    count once; a null key keeps its row and gets no class.
    """
    scratch = Scratch(media.sparkSession)
    named = media.select(F.col(key).cast("long").alias(key), F.xxhash64(image, F.length(image)).alias("pixels"), F.col(image).isNotNull().alias("there"))
    named = scratch.save(named, "named")
    same = named.where(f"there AND `{key}` IS NOT NULL").groupBy("pixels").agg(F.min(key).alias("first"))
    own = named.where("there").join(same, "pixels").where(F.col(key) == F.col("first")).select(key).distinct()
    kept = media.select(F.col(key).cast("long").alias(key), image).join(own, key)
    f = scratch.save(features(kept, key, image).withColumnRenamed(key, "id").distinct(), "features")
    links = linked(f, differing, agreeing, scratch)
    roots = components(links, scratch)
    degree = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))
    amount = f.groupBy(F.col("id").alias("v")).agg(F.count("*").alias("n_features"))
    out = named.join(same, "pixels", "left").withColumn("v", F.when(F.col("there"), F.col("first")).otherwise(F.col(key)))
    out = out.join(roots, "v", "left").join(degree, "v", "left").join(amount, "v", "left")
    zero = F.lit(0).cast("long")
    return out.select(key, F.coalesce("n_features", zero).alias("n_features"), F.when(F.col(key).isNotNull(), F.coalesce("root", "v")).alias("class_id"), F.coalesce("n_links", zero).alias("n_links"))


#: The orders in which a drawing's quarters take the components.
ORDERS = [np.random.default_rng(7 + k).permutation(64) for k in range(4)]


def drawn(vector) -> np.ndarray:
    """A 64 x 64 image of a vector: 16 x 16 squares, its first 64 components in four orders. A feature's patch spans some sixteen squares, so features tell images apart."""
    v = np.nan_to_num(np.asarray(vector, np.float64)[:64], posinf=0, neginf=0)
    v = np.pad(v, (0, 64 - len(v)))
    spread = np.abs(v).max() or 1.0
    a, b, c, d = (np.rint(128 + 120 * v[o] / spread).reshape(8, 8) for o in ORDERS)
    return np.kron(np.block([[a, b], [c, d]]), np.ones((4, 4))).clip(0, 255).astype(np.uint8)


def edited(image: np.ndarray, how: int) -> np.ndarray:
    """A copy: cropped, darker, of more contrast, or turned by a right angle."""
    x = image.astype(np.float64)
    if how == 0:
        return image[6:60, 9:62]
    if how == 1:
        return (x * 0.8 + 10).astype(np.uint8)
    if how == 2:
        return ((x - 128) * 1.05 + 128).clip(0, 255).astype(np.uint8)
    return np.rot90(image)


def gallery(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(media_id, image): a drawing of every vector under twice its id, and for every fourth an edited copy under the next odd number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, made = [], []
                for i, v in zip(b.column(id).to_pylist(), b.column(vector).to_pylist()):
                    image = drawn([x if x is not None else 0.0 for x in v or []])
                    ids.append(2 * i)
                    made.append(to_pgm(image))
                    if i % 4 == 0:
                        ids.append(2 * i + 1)
                        made.append(to_pgm(edited(image, i // 4 % 4)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["media_id", "image"])

    return vectors.select(id, vector).where(F.col(id).isNotNull()).mapInArrow(run, T.StructType([T.StructField("media_id", T.LongType()), T.StructField("image", T.BinaryType())]))
