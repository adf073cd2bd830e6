"""License scan: winnowed fingerprints of templates in an inverted index, then banded alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Notices that licenses ask to be put into works.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Bytes of a fingerprint's gram.
GRAM = 8
#: Grams of a winnowing window: any shared run of GRAM + WINDOW - 1 bytes is found.
WINDOW = 6
GAP = b"\0" * GRAM
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _folded() -> np.ndarray:
    """Bytes in lower case, white space and comment marks as spaces; lengths stay, so places do."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13, 35, 42, 47]] = 32
    return table


FOLDED = _folded()


def folded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with each run of spaces as one, Unicode's among them, and the place in the data of each."""
    raw = np.frombuffer(data, np.uint8)
    b = FOLDED[raw]
    if len(b) > 2 and (raw > 127).any():
        one, two, three = raw[:-2], raw[1:-1], raw[2:]
        pair = np.flatnonzero((raw[:-1] == 0xC2) & ((raw[1:] == 0xA0) | (raw[1:] == 0x85)))
        general = (one == 0xE2) & (two == 0x80) & ((three >= 0x80) & (three <= 0x8B) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
        triple = np.flatnonzero(general | ((one == 0xE2) & (two == 0x81) & (three == 0x9F)) | ((one == 0xE3) & (two == 0x80) & (three == 0x80)))
        if len(pair) or len(triple):
            b[np.concatenate([pair, pair + 1, triple, triple + 1, triple + 2])] = 32
    kept = np.flatnonzero(np.append(True, (b[1:] != 32) | (b[:-1] != 32))[: len(b)])
    return b[kept], kept


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 8 folded bytes at each place, as a number, and the places."""
    b, at = folded(data)
    if len(b) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32)), at[: len(b) - GRAM + 1]


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of each window's least hash, the last on ties."""
    out: list[int] = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = i + len(part) - 1 - int(np.argmin(part[::-1]))
        if not out or out[-1] != at:
            out.append(at)
    return out if len(hashes) else []


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


class Index:
    """Fingerprints of templates: gram to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [[w for w, _, _ in words(templates[n])] for n in self.names]
        self.length = [len(templates[n].encode("utf-8")) for n in self.names]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, name in enumerate(self.names):
            g, place = grams(templates[name].encode("utf-8"))
            for at in winnow(g * MULTIPLIER, WINDOW):
                self.places[int(g[at])].append((t, int(place[at])))
        count = [sum(t == x for v in self.places.values() for x, _ in v) for t in range(len(self.names))]
        self.least = [max(1, c // 5) for c in count]
        self.keys = np.array(sorted(self.places), np.uint64)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.keys * MULTIPLIER >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(place, gram) wherever a text has an indexed gram. Every place is looked up, a superset of a winnowed text's."""
        g, place = grams(data)
        near = np.flatnonzero(self.coarse[(g * MULTIPLIER >> np.uint64(48)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return []
        found = g[near]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        ok = self.keys[at] == found
        return list(zip(place[near[ok]].tolist(), found[ok].tolist()))


def align(template: list[str], text: list[str], band: int) -> tuple[int, int, int]:
    """(matched, first, last): the best alignment of a template's words with a text's, last being exclusive.

    Matches gain 1, mismatches lose 0.5, words left out on either side 0.3; ends of the text are free, and places
    further than `band` from the diagonal aren't visited.
    """
    n, m = len(template), len(text)
    wide = max(band, m - n + band)
    before = {j: (0.0, 0, j) for j in range(min(m, wide) + 1)}  # score, matched, first
    for i in range(1, n + 1):
        now: dict[int, tuple[float, int, int]] = {}
        for j in range(max(0, i - band), min(m, i + wide) + 1):
            best = (-1e9, 0, j)
            if (p := before.get(j)) and p[0] - 0.3 > best[0]:
                best = (p[0] - 0.3, p[1], p[2] if p[1] else j)
            if j and (p := before.get(j - 1)):
                same = template[i - 1] == text[j - 1]
                score = p[0] + (1 if same else -0.5)
                if score >= best[0]:
                    best = (score, p[1] + same, p[2] if p[1] else j - 1 if same else j)
            if j and (p := now.get(j - 1)) and p[0] - 0.3 > best[0]:
                best = (p[0] - 0.3, p[1], p[2] if p[1] else j)
            now[j] = best
        before = now
    if not before:
        return 0, 0, 0
    end = max(before, key=lambda j: (before[j][0], -j))
    return before[end][1], before[end][2], end


def matches(text: str, hits: list[tuple[int, int]], index: Index, coverage: float, band: int) -> list[dict]:
    """Template matches of one text, from its hits in bytes; spans in code points. Of overlapping ones the one with most matched words stays."""
    data = text.encode("utf-8")
    begins: dict[int, list[int]] = defaultdict(list)
    for at, gram in hits:
        for t, place in index.places[gram]:
            begins[t].append(at - place)
    found = []
    for t, diagonals in begins.items():
        slack, done = 16 + index.length[t] // 4, None
        diagonals.sort()
        for k, d in enumerate(diagonals):
            # a match has a fifth of the template's fingerprints near one diagonal at least
            few = k + index.least[t] - 1
            if done is not None and d <= done or few >= len(diagonals) or diagonals[few] > d + slack:
                continue
            done = d + slack
            lo, hi = max(0, d - slack), min(len(data), d + index.length[t] + 2 * slack)
            shift = len(data[:lo].decode("utf-8", "ignore"))
            part = text[shift : shift + len(data[lo:hi].decode("utf-8", "ignore"))]
            w = words(part)
            need = index.words[t]
            matched, first, last = align(need, [x for x, _, _ in w], band)
            if matched and matched >= coverage * len(need):
                while last > first and w[last - 1][0] not in need:
                    last -= 1
                found.append({"license": index.names[t], "coverage": matched / len(need), "matched_words": matched, "start": shift + w[first][1], "end": shift + w[last - 1][2]})
    found.sort(key=lambda f: (-f["matched_words"], -f["coverage"], f["start"], f["license"]))
    kept: list[dict] = []
    for f in found:
        if all(f["end"] <= k["start"] or k["end"] <= f["start"] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f["start"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.85, band: int = 12) -> DataFrame:
    """(key, license, coverage, matched_words, start, end): license notices in whole texts.

    Coverage is the share of the template's words that the alignment matches; start and end are code points, end
    exclusive. Null and empty texts give no rows; rows that repeat a key give theirs each. The index is as large as
    the templates, not the corpus, and goes to every task.
    """
    held = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(text).to_pylist()
                parts = [(t or "").encode("utf-8") + GAP for t in texts]
                starts = np.cumsum([0, *map(len, parts)])[:-1]
                per_text: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for place, gram in index.hits(b"".join(parts)):
                    i = int(np.searchsorted(starts, place, "right")) - 1
                    per_text[i].append((place - int(starts[i]), gram))
                rows = [(i, f) for i, hits in per_text.items() for f in matches(texts[i], hits, index, coverage, band)]
                if rows:
                    made = pa.Table.from_pylist([f for _, f in rows], pa.schema([("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
                    yield from made.add_column(0, key, [b.column(key).take(pa.array([i for i, _ in rows]))]).to_batches()

    own = docs.schema[key].dataType
    fields = [T.StructField(key, own), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType())]
    fields += [T.StructField(c, T.IntegerType()) for c in ("matched_words", "start", "end")]
    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
