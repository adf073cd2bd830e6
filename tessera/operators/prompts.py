"""Prompt building: exemplars, budgets, options, blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def question_answer(q: Column, a: Column) -> Column:
    return F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a, F.lit("\n\n"))


def exemplars(df: DataFrame, order: str, rendered: Column) -> DataFrame:
    """One row: a stated few rows rendered and joined in order."""
    return df.agg(F.array_sort(F.collect_list(F.struct(F.col(order), rendered.alias("s")))).alias("x")).select(F.array_join(F.transform("x", lambda s: s["s"]), "").alias("shots"))


def within_budget(df: DataFrame, order: str, rendered: Column, most: int) -> DataFrame:
    """As `exemplars`, but only as many as hold `most` words together. The rows are a handful of exemplars, so one task orders them."""
    words = F.regexp_count(rendered, F.lit(r"[^ \n]+"))
    used = F.sum(words).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return exemplars(df.withColumn("_used", used).withColumn("_r", rendered).where(F.col("_used") <= most), order, F.col("_r"))


def lettered(options: Column, tail: str = "\nAnswer:") -> Column:
    letter = lambda i: F.substring(F.lit(LETTERS), i + 1, F.lit(1))
    return F.concat(F.array_join(F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o)), "\n"), F.lit(tail))


def bracketed(options: Column) -> Column:
    letter = lambda i: F.substring(F.lit(LETTERS), i + 1, F.lit(1))
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("("), letter(i), F.lit(") "), o, F.lit("\n"))), "")


def option_map(options: Column) -> Column:
    """Letter to option."""
    letters = F.transform(options, lambda o, i: F.substring(F.lit(LETTERS), i + 1, F.lit(1)))
    return F.map_from_arrays(letters, options)


def permuted(options: Column, seed: Column) -> Column:
    """Options in an order that an MD5 of seed and place gives: array of (key, o, i), i being the place before."""
    keyed = F.transform(options, lambda o, i: F.struct(F.md5(F.concat(seed.cast("string"), F.lit(":"), i.cast("string"))).alias("key"), o.alias("o"), i.alias("i")))
    return F.array_sort(keyed)


def quarters(lines: Column) -> Column:
    """Lines in four blocks of a quarter each, the last with the rest."""
    k = F.floor(F.size(lines) / 4).cast("int")
    block = lambda i: F.array_join(F.when(k > 0, F.slice(lines, k * i + 1, k)).otherwise(F.array().cast("array<string>")), "\n")
    return F.array(block(0), block(1), block(2), F.array_join(F.slice(lines, k * 3 + 1, F.size(lines) - k * 3), "\n"))


def topic_messages(system: str, template: str, **values: Column) -> Column:
    """A system message and a user message: the template with each {name} replaced by its value, the text of a value as it is."""
    parts = re.split(r"\{(\w+)\}", template)
    user = F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    return F.array(*[F.struct(F.lit(role).alias("role"), said.alias("content")) for role, said in (("system", F.lit(system)), ("user", user))])
