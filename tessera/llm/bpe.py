"""Byte-level BPE encoding and decoding with a public vocabulary."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The pattern by which byte-level BPE splits text. White space as Unicode's property has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pieces of more bytes are merged with a heap, whose time doesn't grow with the square of the length.
SHORT = 128
#: Pieces a worker remembers.
REMEMBERED = 300_000
BIG = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file: itself if visible in Latin-1, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Coder:
    """A vocabulary: `encode` and `decode` give what the tokenizers library gives for the same file, without added special tokens."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, to_byte = data["model"], byte_letters()
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data.get("normalizer") or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normaliser or added space is needed")
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.id_of_byte = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        # the longest wins where several begin at one place
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece. Contiguous arrays hold its parts and the rank of each with its neighbour: find the least rank, first on ties, join there, look up the two ranks beside it, and so on."""
        ids = [self.id_of_byte[b] for b in piece]
        if len(ids) > SHORT:
            return self.merge_long(ids)
        none = (BIG, 0)
        look = self.merges.get
        pairs = [look(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        ranks = [p[0] for p in pairs]
        into = [p[1] for p in pairs]
        while ranks:
            least = min(ranks)
            if least == BIG:
                break
            i = ranks.index(least)
            ids[i] = new = into[i]
            del ids[i + 1], ranks[i], into[i]
            if i:
                ranks[i - 1], into[i - 1] = look(ids[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i], into[i] = look(new << 32 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same tokens for long pieces: a linked list of parts and a heap of (rank, place)."""
        n, look = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := look(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if p := look(new << 32 | ids[after[j]]):
                    heapq.heappush(heap, (p[0], i, new, ids[after[j]], p[1]))
            if (h := before[i]) >= 0 and (p := look(ids[h] << 32 | new)):
                heapq.heappush(heap, (p[0], h, ids[h], new, p[1]))
        return [t for t, ok in zip(ids, alive) if ok]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        parts = self.split_added.split(text) if self.split_added and any(s in text for s in self.added) else (text,)
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
                continue
            for piece in self.pieces(part):
                try:
                    out += known[piece]
                except KeyError:
                    got = tuple(self.merge(piece.encode()))
                    if len(piece) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[piece] = got
                    out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become U+FFFD, one for each maximal part; ids that the vocabulary lacks give nothing."""
        of = self.bytes_of
        return b"".join([of.get(i, b"") for i in ids]).decode("utf-8", "replace")


_CODERS: dict[int, Coder] = {}


def coder(spec: str) -> Coder:
    """One for each worker process and vocabulary."""
    key = hash(spec)
    if key not in _CODERS:
        _CODERS[key] = Coder(spec)
    return _CODERS[key]


def values(column: pa.Array) -> list:
    """A column's Python values; null lists as empty ones. Lists of numbers go through one flat array."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = np.asarray(column.flatten()), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
    return [x.tolist() for x in np.split(flat, ends[:-1])] if len(ends) else []


def _mapped(df: DataFrame, column: str, into: str, kind: pa.DataType, spark_type: T.DataType, f, rows: int = 256) -> DataFrame:
    """Appends a column made of another, a few rows at a time, so that a batch of long texts stays small."""
    if into in df.columns:
        df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                made = pa.array([f(x) for x in values(b.column(column))], kind)
                yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, spark_type)]))


def read_vocabulary(path: str) -> str:
    """The driver reads the file; tasks get its text, so executors needn't have the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Appends the token ids (array of ints) of a column's whole texts. Null counts as empty: no tokens.

    `vocabulary` is a file in the tokenizers library's format. Strings of added tokens in a text become their ids, as
    the library does by default. A column already called `ids` is replaced; other columns stay.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return _mapped(df, text, ids, pa.list_(pa.int32()), T.ArrayType(T.IntegerType()), lambda x: coder(spec.value).encode(x or ""))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Appends the text of a column of token ids; null counts as none: an empty text."""
    spec = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return _mapped(df, ids, text, pa.string(), T.StringType(), lambda x: coder(spec.value).decode(x or []))
