"""Interfaces to models and tokenizers, with stand-ins for tests. A model runs over Arrow batches, with retries."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class Echo:
    """Answers with a digest of the prompt."""

    def complete(self, prompt: str) -> str:
        return hashlib.md5(prompt.encode()).hexdigest()


def retried(call: Callable[[str], str], prompt: str, tries: int = 3, first: float = 0.8, factor: float = 1.8, sleep=time.sleep) -> tuple[str | None, str | None]:
    """(answer, error): waits first * factor^k and up to 0.2 s more between tries."""
    error = None
    for k in range(tries):
        try:
            return call(prompt), None
        except Exception as e:  # a failed row is reported, others go on
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                sleep(first * factor**k + random.uniform(0, 0.2))
    return None, error


def completed(df: DataFrame, prompt: str, model: Completer, workers: int = 8) -> DataFrame:
    """Appends `completion` and `error`; a bounded pool of calls runs in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                got = list(pool.map(lambda p: retried(model.complete, p or ""), b.column(prompt).to_pylist()))
                more = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "completion", "error"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("completion", T.StringType()), T.StructField("error", T.StringType())]))


def forked(df: DataFrame, id: str, branches: list[tuple[str, Column]]) -> DataFrame:
    """A row for each branch of a program: (id, branch, prompt)."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("branch"), c.alias("prompt")) for i, (n, c) in enumerate(branches)])
    return df.select(id, F.explode(each).alias("b")).select(id, "b.place", "b.branch", "b.prompt")


def gathered(df: DataFrame, id: str, value: str) -> DataFrame:
    """A list of the branches' values in the order of the fork."""
    return df.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias("values"))
