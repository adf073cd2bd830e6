"""Programs of prompts over the rows of a frame: text, roles, completions, numbers and choices, each step a column."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import answers, models

#: Takes an array of each choice's token log-probabilities and gives a place, from 0.
ChoiceMethod = Callable[[Column], Column]
SAID, OPTIONS = "_said", "_options"


class Scorer(Protocol):
    def logprobs(self, prompt: str, choice: str) -> list[float]: ...


class Hashed:
    """Log-probabilities of two tokens from a digest."""

    def logprobs(self, prompt: str, choice: str) -> list[float]:
        return [-float(int(d, 16)) for d in hashlib.md5((prompt + choice).encode()).hexdigest()[:2]]


class State:
    """What a program has said so far in each row, and the columns that it named. Each step adds to it and returns it."""

    def __init__(self, df: DataFrame, model: models.Completer, scorer: Scorer, method: ChoiceMethod):
        self.df, self.model, self.scorer, self.method = df.withColumn(SAID, F.lit("")), model, scorer, method

    def say(self, *parts: Column | str) -> State:
        self.df = self.df.withColumn(SAID, F.concat(SAID, *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
        return self

    def _role(self, name: str, parts) -> State:
        return self.say(f"<|{name}|>\n", *parts, "\n")

    def system(self, *parts: Column | str) -> State:
        return self._role("system", parts)

    def user(self, *parts: Column | str) -> State:
        return self._role("user", parts)

    def assistant(self, *parts: Column | str) -> State:
        return self._role("assistant", parts)

    def gen(self, name: str) -> State:
        """The model goes on from here; null, and nothing said, where it fails."""
        self.df = models.completed(self.df, SAID, self.model).withColumnRenamed("completion", name).drop("error")
        return self.say(F.col(name))

    def gen_int(self, name: str) -> State:
        """As `gen`, but of the completion only its first whole number, of up to 18 digits, is kept and said."""
        self.df = models.completed(self.df, SAID, self.model).withColumn(name, F.regexp_extract("completion", "[0-9]{1,18}", 0).try_cast("long")).drop("completion", "error")
        return self.say(F.col(name))

    def select(self, name: str, options: list[str]) -> State:
        """One of the options, which the choice method picks by their log-probabilities after what was said."""
        scored = self.df.mapInArrow(self._scores(options), T.StructType([*self.df.schema.fields, T.StructField(OPTIONS, T.ArrayType(T.ArrayType(T.DoubleType())))]))
        at = self.method(F.col(OPTIONS)).cast("int")
        self.df = scored.withColumn(name, F.get(F.array(*map(F.lit, options)), at)).drop(OPTIONS)
        return self.say(F.col(name))

    def _scores(self, options: list[str]):
        scorer = self.scorer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [[scorer.logprobs(p, o) for o in options] for p in b.column(SAID).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.list_(pa.float64())))], [*b.schema.names, OPTIONS])

        return run


class Program:
    """A function of a state and of columns by name. Fixed values may be bound to names that a frame lacks."""

    def __init__(self, body: Callable[..., State], model: models.Completer, scorer: Scorer, method: ChoiceMethod, bound: dict | None = None):
        self.body, self.model, self.scorer, self.method, self.bound = body, model, scorer, method, bound or {}

    def bind(self, **values) -> Program:
        return Program(self.body, self.model, self.scorer, self.method, self.bound | values)

    def run_batch(self, df: DataFrame, *names: str) -> DataFrame:
        """The frame with the columns that the program made and `said`, its whole text. `names` are the columns that it takes."""
        done = self.body(State(df, self.model, self.scorer, self.method), **{n: F.col(n) for n in names}, **{k: F.lit(v) for k, v in self.bound.items()})
        return done.df.withColumnRenamed(SAID, "said")


def function(model: models.Completer | None = None, scorer: Scorer | None = None, method: ChoiceMethod = answers.best_choice) -> Callable[[Callable[..., State]], Program]:
    """Makes a program of a function."""
    return lambda body: Program(body, model or models.Echo(), scorer or Hashed(), method)


def processed(scores: Column, params: Column, processor: Callable[[np.ndarray, dict], np.ndarray]) -> Column:
    """Scores of tokens after a processor, which gets each row's own parameters from a JSON text (null: none). Null scores stay null."""

    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(processor(np.array(x, np.float64), json.loads(q) if q else {}), np.float64) for x, q in zip(s, p)])

    return F.pandas_udf(run, "array<double>")(scores.cast("array<double>"), params)
