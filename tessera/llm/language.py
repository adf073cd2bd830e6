"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
#: Hashed trigrams of bytes.
DIM = 4096

#: Families of some language codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "sinitic": ("zh", "yue", "wuu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "am", "mt"),
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), lang)


def _letters() -> np.ndarray:
    """Byte classes: lower-case letters and bytes above ASCII as they are, everything else a space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letters()


def grams(buffer: np.ndarray) -> np.ndarray:
    """The hashed trigram at each place of a byte buffer, its last two places excepted."""
    b = LETTERS[buffer].astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - DIM.bit_length() + 1)


def framed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, each between two spaces, and where each begins."""
    parts = [b"  " + t.encode("utf-8") + b"  " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts]


def features(text: str) -> np.ndarray:
    """Shares of the hashed trigrams of a whole text, times 100, so that a linear score is a mean over places."""
    buffer, _ = framed([text])
    counts = np.bincount(grams(buffer), minlength=DIM).astype(np.float32)
    return counts * (100 / counts.sum())


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by gradient descent with momentum. y is -1 or 1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1])
    top = np.ones(x.shape[1])
    for _ in range(20):  # the largest eigenvalue, for the step's length
        top = x.T @ (share * (x @ top))
        top /= (size := np.linalg.norm(top))
    rate = 1 / (1 + 2 * c * 1.2 * size)
    for k in range(steps):
        at = w + (k / (k + 3)) * (w - v)
        slack = np.maximum(0, 1 - y * (x @ at))
        v, w = w, at - rate * (at - 2 * c * (x.T @ (share * y * slack)))
    return w


@dataclass
class Model:
    """Linear scores: one for each family against the rest, then one for each pair of a family's languages."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> Model:
        m, lang = Model(), np.array(langs)
        for name in sorted({family(a) for a in langs}):
            m.families.append(name)
            m.members[name] = sorted({a for a in langs if family(a) == name})
        of = np.array([family(a) for a in langs])
        found = []
        if len(m.families) > 1:
            found += [svm(x, np.where(of == name, 1, -1)) for name in m.families]
        for name in m.families:
            for a, b in combinations(m.members[name], 2):
                both = (lang == a) | (lang == b)
                m.pairs.append((a, b))
                found.append(svm(x[both], np.where(lang[both] == a, 1, -1)))
        if found:
            w = np.array(found, np.float32).T
            # counts are shares times 100, so a place of a text of n places weighs 100 / n
            m.weights, m.bias = np.ascontiguousarray(w[:-1] * 100), w[-1]
        return m

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text. The score is the product of logistic margins on the way, between 0 and 1."""
        if not texts or not self.families:
            return [(UNDETERMINED, 0.0)] * len(texts)
        buffer, starts = framed(texts)
        h = grams(np.append(buffer, [32, 32]).astype(np.uint8))
        n = np.diff(np.append(starts, len(buffer)))
        # a text's last two grams reach into the next one's frame: spaces, whatever the text
        scores = np.stack([np.add.reduceat(self.weights[:, k][h], starts) / n + self.bias[k] for k in range(len(self.bias))], 1) if len(self.bias) else np.zeros((len(texts), 0))
        near = 1 / (1 + np.exp(-np.clip(3 * scores, -30, 30)))
        out = []
        many = len(self.families) if len(self.families) > 1 else 0
        at = {p: many + k for k, p in enumerate(self.pairs)}
        for s, p in zip(scores, near):
            best = int(np.argmax(s[:many])) if many else 0
            sure = float(p[best]) if many else 1.0
            langs = self.members[self.families[best]]
            votes = {a: [0, 0.0] for a in langs}
            for a, b in combinations(langs, 2):
                k = at[a, b]
                win = a if s[k] >= 0 else b
                votes[win][0] += 1
                votes[a][1] += float(p[k])
                votes[b][1] += 1 - float(p[k])
            lang = max(langs, key=lambda a: (votes[a][0], votes[a][1]))
            inner = votes[lang][1] / (len(langs) - 1) if len(langs) > 1 else 1.0
            out.append((lang, min(1.0, max(0.0, sure * inner))))
        return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = 400) -> Model:
    """Fits a model on about `per_language` documents of each language, chosen by a hash of their id and text.

    That is the documented bound of the sample: each language's documents are taken with probability
    per_language / count, so the driver gets some 400 rows of 4,096 shares a language whatever the input's size.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(id).alias("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    chance = F.element_at(F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))]), F.col("lang"))
    u = F.shiftrightunsigned(F.xxhash64("id", "text"), 1) / F.lit(float(1 << 63))
    some = rows.where(u < chance)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("id").cast(pa.string()), pa.array(made, pa.binary())], ["lang", "id", "x"])

    got = some.mapInArrow(shares, "lang string, id string, x binary").toArrow().sort_by([("lang", "ascending"), ("id", "ascending"), ("x", "ascending")])
    if not got.num_rows:  # every language's few documents missed the draw: those that came nearest
        got = rows.orderBy(u / chance, "lang", "id", "text").limit(per_language).mapInArrow(shares, "lang string, id string, x binary").toArrow()
    x = np.stack([np.frombuffer(v, np.float32) for v in got.column("x").to_pylist()])
    return Model.fit(x, got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """Appends the language of every whole text and a score from 0 to 1.

    `und` and 0 where the text is null or has no letter, and everywhere if nothing was learned. Columns of these names
    are replaced. Repeated rows get the same answer.
    """
    docs = docs.drop(lang, score)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(text).to_pylist()
                lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                found = [(UNDETERMINED, 0.0)] * len(texts)
                for i, answer in zip(lettered, m.predict([texts[i] for i in lettered])):
                    found[i] = answer
                more = [pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], [*names, lang, score])

    fields = [f for f in docs.schema.fields if f.name in names]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(id) -> F.Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
