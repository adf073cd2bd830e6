"""Answers: extraction, normalisation, scoring."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import strip

INVALID = -9999999


def last_integer(c: Column) -> Column:
    """The last run of digits once commas are gone; INVALID without one, with a leading zero, or out of a long's range."""
    found = F.try_element_at(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1))
    plain = F.when(~found.rlike(r"^0\d"), found)
    return F.coalesce(plain.try_cast("long"), F.lit(INVALID))


def first_char(c: Column) -> Column:
    return F.substring(strip(c), 1, 1)


def stated_choice(c: Column, letters: str = "A-D") -> Column:
    """The letter after "Answer:", its case as written; null without one."""
    return F.nullif(F.regexp_extract(c, rf"(?i)Answer[ \t]*:[ \t]*\$?([{letters}])\$?", 1), F.lit(""))


def stated_line(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)Answer\s*:\s*([^\n]+)", 1), F.lit(""))


def number_after(c: Column, prefix: str) -> Column:
    """The last number after the last occurrence of a prefix, without commas, and without trailing zeros if it has a point; empty without the prefix or a number."""
    tail = F.when(F.instr(c, prefix) > 0, F.substring_index(c, prefix, -1))
    found = F.try_element_at(F.regexp_extract_all(F.replace(tail, F.lit(","), F.lit("")), F.lit(r"(\d+\.?\d*)"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.when(found.contains("."), F.regexp_replace(found, r"\.?0*$", "")).otherwise(found), F.lit(""))


def by_phrases(c: Column, phrases: tuple[str, ...]) -> Column:
    """What follows the first phrase of a list that occurs, up to the line's end, without a final full stop and asterisks."""
    tries = [F.nullif(F.regexp_extract(c, f"{p}[ :]*([^\n]+)", 1), F.lit("")) for p in phrases]
    return F.regexp_replace(F.coalesce(*tries), r"^[.*\s]+|[.*\s]+$", "")


def fenced_code(c: Column, language: str = "python") -> Column:
    """The first fenced block of a language, else everything; without a signature line."""
    block = F.regexp_extract(c, rf"(?s)```{language}\n(.*?)```", 1)
    body = F.when(block != "", block).otherwise(c)
    at = F.locate(":\n    ", body)
    return F.when(at > 0, F.substring(body, at + 2, F.length(body))).otherwise(body)


def last_output(c: Column) -> Column:
    """The last fenced `output` block."""
    return F.when(c.contains("```output"), strip(F.substring_index(F.substring_index(c, "```output", -1), "```", 1))).otherwise(F.lit(""))


def boxed_text(s: str) -> str | None:
    """What the last `boxed` holds: to its matching brace, or without braces to the next dollar sign."""
    tail = s.rpartition("boxed")[2] if "boxed" in s else None
    if tail is None:
        return None
    if not tail.startswith("{"):
        return tail.split("$")[0].strip()
    depth = 0
    for i, ch in enumerate(tail):
        depth += (ch == "{") - (ch == "}")
        if not depth:
            return tail[1:i]
    return tail[1:]


# Rewrites of mathematical notation, in order: pattern and replacement.
NOTATION = (
    (r"\n|\\!|\\ |\s+", ""),
    (r"\\[td]frac", r"\\frac"),
    (r"\\left|\\right|\^\{?\\circ\}?|\\\$|\$", ""),
    (r"\\text\{[^}]*\}$", ""),
    (r"\\?%", ""),
    (r"^\.(?=\d)", "0."),
    (r"(?<=[{,(=])\.(?=\d)", "0."),
    (r"infinity|inf(?!ty)", r"\\infty"),
    (r"\\sqrt(\w)", r"\\sqrt{\1}"),
    (r"\\frac(\w)(\w)", r"\\frac{\1}{\2}"),
    (r"\\frac(\w)\{", r"\\frac{\1}{"),
    (r"^(-?\d+)/(-?\d+)$", r"\\frac{\1}{\2}"),
    (r"(\d)\.0+(?=\D|$)", r"\1"),
    (r"^[a-zA-Z]=", ""),
)
_NOTATION = [(re.compile(a), b) for a, b in NOTATION]


def normal_math(s: str) -> str:
    for pattern, new in _NOTATION:
        s = pattern.sub(new, s)
    return s.strip().rstrip(".")


def math_answer(s: str) -> str:
    """The stated final answer, else the boxed one, else what follows "the answer is", else the last number; normalised."""
    if "final answer is $" in s:
        found = s.split("final answer is $")[-1].split("$")[0]
    elif (b := boxed_text(s)) is not None:
        found = b
    elif "he answer is" in s:
        found = s.split("he answer is")[-1]
    else:
        numbers = re.findall(r"-?\d*\.?\d+", s.replace(",", ""))
        found = numbers[-1] if numbers else ""
    return normal_math(found.strip().split("\n")[0].lstrip(":").strip().rstrip("./"))


def _number(s: str) -> float | None:
    s = s.replace(",", "")
    try:
        return float(s[:-1]) / 100 if s.endswith(("%", "\\%")) else float(s)
    except ValueError:
        m = re.fullmatch(r"(-?)\\frac\{(-?\d+\.?\d*)\}\{(-?\d+\.?\d*)\}", s)
        return (-1 if m[1] else 1) * float(m[2]) / float(m[3]) if m and float(m[3]) else None


def math_equal(a: str, b: str) -> bool:
    """Equal as texts, as numbers within 0.001 of the reference or a hundred times more or less, or element by element."""
    a, b = a.strip(), b.strip()
    if a.lower() == b.lower():
        return True
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return any(abs(x - r) <= max(1e-3, 1e-9 * abs(r)) for r in (y, y / 100, y * 100))
    inner = [re.fullmatch(r"[(\[](.+)[)\]]", s) for s in (a, b)]
    if all(inner):
        parts = [m[1].split(",") for m in inner]
        return len(parts[0]) == len(parts[1]) and all(math_equal(p, q) for p, q in zip(*parts))
    return False


@F.pandas_udf(T.StringType())
def extract_math(s: pd.Series) -> pd.Series:
    return s.map(math_answer, na_action="ignore")


@F.pandas_udf(T.StringType())
def boxed(s: pd.Series) -> pd.Series:
    return s.map(boxed_text, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def equal_math(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and math_equal(x, y) for x, y in zip(a, b)])


def several_answers(c: Column, question: Column) -> Column:
    """Answers split by commas only if the question asks for that and no bracket is there."""
    listed = question.contains("separated by commas") & ~c.rlike(r"[(\[]")
    return F.when(listed, F.transform(F.split(c, ","), strip)).when(c.contains(r"\text{and}"), F.transform(F.split(c, r"\\text\{and\}"), strip)).otherwise(F.array(c))


def chosen_option(c: Column, options: Column, letters: str = "ABCD") -> Column:
    """The option a free answer names: a bracketed letter, else a letter by itself, else an option's text in answers of over 5 words; of several, the last. Null if none is named."""
    padded = F.concat(F.lit(" "), F.regexp_replace(c, r"^[,.!?;:']+|[,.!?;:']+$", ""), F.lit(" "))
    last = lambda what: F.length(padded) - F.length(F.substring_index(padded, what, -1))
    at = lambda form: F.array(*[F.struct(F.when(padded.contains(form(x)), last(form(x))).alias("at"), F.lit(x).alias("letter")) for x in letters])
    best = lambda xs: F.array_max(F.filter(xs, lambda s: s["at"].isNotNull()))["letter"]
    place = lambda o: F.length(padded) - F.length(F.element_at(F.split(F.lower(padded), F.concat(F.lit(r"\Q"), F.lower(o), F.lit(r"\E"))), -1))
    texts = F.filter(F.transform(options, lambda o, i: F.struct(F.when(F.contains(F.lower(padded), F.lower(o)), place(o)).alias("at"),F.substring(F.lit(letters), i + 1, F.lit(1)).alias("letter"))), lambda s: s["at"].isNotNull())
    long = F.size(F.split(padded, r"\s+")) - 2 > 5
    return F.coalesce(best(at(lambda x: f"({x})")), best(at(lambda x: f" {x} ")), F.when(long, F.array_max(texts)["letter"]))


def numbers_in(c: Column) -> Column:
    """Numbers with thousands' commas, then in scientific notation, then plain ones."""
    with_commas, scientific = r"(-?\b\d{1,3}(?:,\d{3})+\b)", r"(-?\d+(?:\.\d+)?[eE][+-]?\d+)"
    plain = r"(-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d]))"
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (with_commas, scientific, plain)])


def normal_value(c: Column) -> Column:
    """Numbers rounded to two places, half to even; other texts in lower case, single characters between spaces."""
    n = F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    text = F.lower(strip(c))
    return F.when(n.isNotNull(), F.bround(n, 2).cast("string")).when(F.length(text) == 1, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text)


def any_number_is(c: Column, label: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_contains(found, label)).otherwise(c == label)


def holds_all_words(c: Column, label: Column) -> Column:
    return F.forall(F.split(F.lower(label), " "), lambda w: F.contains(F.lower(c), w))


def any_of(c: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(c, g))


# Words before an answer; the last counts in the last line only. Tails of one of these marks say nothing.
BEFORE_ANSWER = ("could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ", "=")
MARKS = (":", ",", ".", "!", "?", ";", "'")


def _values(found: Column) -> Column:
    """(strs, nums): texts in lower case, single characters with a space before or after; numbers rounded to two places."""
    number = lambda x: F.replace(strip(x), F.lit(","), F.lit(""))
    is_number = lambda x: number(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    forms = lambda x: F.when(F.length(x) == 1, F.array(F.concat(F.lit(" "), x), F.concat(x, F.lit(" ")))).otherwise(F.array(x))
    texts = F.flatten(F.transform(F.filter(found, lambda x: ~is_number(x)), lambda x: forms(F.lower(strip(x)))))
    nums = F.transform(F.filter(found, is_number), lambda x: F.bround(number(x).try_cast("double"), 2))
    return F.struct(F.array_distinct(texts).alias("strs"), F.array_distinct(nums).alias("nums"))


def open_answers(c: Column) -> Column:
    """(strs, nums) that a free answer may mean: of each line the shortest text after one of the words before an answer,
    the whole answer if no line has one, and the numbers in them."""
    whole = F.lower(F.regexp_replace(strip(c), r"^\.+|\.+$", ""))
    lines = F.split(whole, "\n")

    def tail(line, i):
        each = F.array(*[F.struct((line.contains(w) & ((i == F.size(lines) - 1) if w == "=" else F.lit(True))).alias("has"), strip(F.substring_index(line, w, -1)).alias("tail")) for w in BEFORE_ANSWER])
        shorter = lambda best, x: (best == "") | (F.length(x["tail"]) < F.length(best))
        return F.aggregate(each, F.lit(""), lambda best, x: F.when(x["has"] & shorter(best, x), x["tail"]).otherwise(best))

    tails = F.filter(F.transform(lines, tail), lambda t: (t != "") & ~t.isin(*MARKS))
    said = F.when(F.size(tails) > 0, tails).otherwise(F.array(whole))
    return _values(F.concat(said, F.flatten(F.transform(said, numbers_in))))


def open_correct(found: Column, golds: Column) -> Column:
    """Whether a text of `open_answers` holds one of the right answers, or a number of it is one."""
    right = _values(golds)
    held = F.exists(found["strs"], lambda s: F.exists(right["strs"], lambda g: F.contains(s, g)))
    return held | F.arrays_overlap(found["nums"], right["nums"])


def best_choice(logprobs: Column, penalty: Column | None = None) -> Column:
    """The place, from 0, of the choice whose tokens' mean log-probability (less an unconditional one's) is largest."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    scores = F.transform(logprobs, lambda xs, i: F.struct((mean(xs) - (penalty[i] if penalty is not None else F.lit(0.0))).alias("s"), (-i).alias("i")))
    return -F.array_max(scores)["i"]


def greedy_choice(logprobs: Column) -> Column:
    """Compares choices token by token, shorter ones going on with their mean up to the longest one's length; the first best stays."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    longest = F.array_max(F.transform(logprobs, F.size))
    filled = F.transform(logprobs, lambda xs, i: F.struct(F.concat(xs, F.array_repeat(mean(xs), F.greatest(F.lit(0), longest - F.size(xs)))).alias("s"), (-i).alias("i")))
    return -F.array_max(filled)["i"]


def logprob_arrays(entries: Column) -> Column:
    """(tokens, logprobs, by_text) of entries (logprob, id, text): parallel arrays, nulls kept, and a map by text, of which the last of a text wins."""
    later = lambda i: F.slice(entries, i + 2, F.greatest(F.lit(1), F.size(entries)))
    last = F.filter(entries, lambda e, i: ~F.exists(later(i), lambda x: x["text"].eqNullSafe(e["text"])) & e["text"].isNotNull())
    return F.struct(
        F.transform(entries, lambda e: e["text"]).alias("tokens"), F.transform(entries, lambda e: e["logprob"]).alias("logprobs"),
        F.map_from_entries(F.transform(last, lambda e: F.struct(e["text"], e["logprob"]))).alias("by_text"),
    )


def label_shares(logprobs: Column) -> Column:
    """Softmax of label tokens' log-probabilities, missing ones 0."""
    e = F.transform(logprobs, lambda x: F.coalesce(F.exp(x), F.lit(0.0)))
    return F.transform(e, lambda x: F.try_divide(x, F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))
