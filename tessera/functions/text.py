"""Scalar text functions: normalisation, ratios, patterns, fingerprints, parsing. All are Column to Column.

Patterns spell character classes out, so they mean the same in every engine: a word character is a letter, a number or
the underscore; white space is Unicode's property plus U+001C to U+001F.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where a word begins or ends.
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Scripts by code point ranges.
HAN = "一-鿿㐀-䶿"
HAN_BASIC = "一-鿿"
HAN_WIDE = r"一-鿿㐀-䶿\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
LATIN = "A-Za-zÀ-ɏ"
SCRIPTS = {"han": HAN, "han_basic": HAN_BASIC, "han_wide": HAN_WIDE, "latin": LATIN}

# Patterns of answers that refuse, warn or advertise. Only the English ones ignore case.
REFUSALS = (
    r"(?i)Only for educational",
    r"(?i)for educational purposes only",
    r"(?i)I cannot assist",
    r"(?i)I (?:can not|cannot) (?:assist|help)",
    r"(?i)as an AI (?:language model)?",
    r"(?i)I do not have (?:access|the ability)",
    r"(?i)I am not a (?:doctor|lawyer|financial advisor)",
    r"(?i)I can(?:’|')t help with that",
    r"敏感.*话题",
    r"违法|违规|侵权",
    r"毒品|爆炸物|枪支",
    r"抱歉.*不能",
    r"抱歉.*无权",
    r"抱歉.*不便",
    r"无法(回答|提供|协助)",
    r"仅供参考",
    r"不提供.*(医疗|法律)建议",
    r"请咨询.*(专业人士|医生|律师)",
    r"点击链接|关注公众号|扫描二维码|加微信|私信我",
)
# Phrases that generated answers mustn't hold.
BAD_PHRASES = ("仅供参考", "免责声明", "抱歉我不能", "无法回答")

URL = r"https?://(?:(?U)\S)+"
PERSONAL = (
    rf"{EDGE_BEFORE}1[3-9]\p{{Nd}}{{9}}{EDGE_AFTER}",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    rf"{EDGE_BEFORE}\p{{Nd}}{{17}}[\p{{Nd}}Xx]|{EDGE_BEFORE}\p{{Nd}}{{15}}{EDGE_AFTER}",
)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _settled() -> str:
    """Characters beyond ASCII, as a class's inside, that NFKC leaves alone whatever is around them: Latin letters, dashes and quotes, unified ideographs."""
    seconds = {int(d[1], 16) for i in range(0x80, 0x3100) if len(d := unicodedata.decomposition(chr(i)).split()) == 2 and d[0][0] != "<"}
    blocks = (range(0x80, 0x250), range(0x2010, 0x2030), range(0x3400, 0x4DC0), range(0x4E00, 0xA000))
    calm = [i for b in blocks for i in b if unicodedata.is_normalized("NFKC", chr(i)) and not unicodedata.combining(chr(i)) and i not in seconds]
    starts = [i for i, before in zip(calm, [None, *calm]) if before != i - 1]
    ends = [i for i, after in zip(calm, [*calm[1:], None]) if after != i + 1]
    return "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in zip(starts, ends))


#: A character that NFKC may change or join with the one before. ASCII fails at the first test.
UNSETTLED = rf"[\x{{80}}-\x{{10FFFF}}&&[^{_settled()}]]"


def to_halfwidth(c: Column) -> Column:
    """Unicode NFKC. Texts that it surely leaves alone don't leave the JVM's hands: a Python function gets all rows, so they are null there."""
    other = F.when(c.rlike(UNSETTLED), c)
    return F.coalesce(_nfkc(other), c)


def squeeze(c: Column) -> Column:
    """Zero-width and no-break spaces as spaces, runs of white space as one space, ends stripped."""
    run = rf"[{SPACE}\x{{200b}}]"
    # single spaces, which most runs are, need no replacement
    return F.trim(F.regexp_replace(c, rf"{run}(?:{run}+|(?<! ))", " "))


def normalize_text(c: Column) -> Column:
    """NFKC, then squeeze; null becomes empty. Line feeds go too, so the result is one line."""
    return squeeze(to_halfwidth(F.coalesce(c, F.lit(""))))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def script_ratio(c: Column, script: str = "han") -> Column:
    """Share of a text's code points in a script; 0 for an empty text."""
    # what the script's runs leave is counted: Java is many times slower at finding the runs of the negated class
    others = F.regexp_replace(c, f"[{SCRIPTS[script]}]+", "")
    return (F.length(c) - F.length(others)) / F.greatest(F.lit(1), F.length(c))


def is_script_char(c: Column, script: str = "han_wide") -> Column:
    return c.rlike(f"^[{SCRIPTS[script]}]$")


def script_ratio_ok(c: Column, script: str = "han_basic", least: float = 0.6) -> Column:
    """At least this share; never for an empty text."""
    return (F.length(c) > 0) & (script_ratio(c, script) >= least)


def length_ok(c: Column, least: int, most: int, stripped: bool = False) -> Column:
    return F.length(strip(c) if stripped else c).between(least, most)


def url_count(c: Column) -> Column:
    return F.when(c.isNull() | c.contains("://"), F.regexp_count(c, F.lit(URL))).otherwise(0)


def too_many_urls(c: Column, most: int = 2) -> Column:
    return url_count(c) > most


def has_pii(c: Column) -> Column:
    """A mobile number, an address with @ or an identity number; cheap tests come before the patterns that need them."""
    phone, email, identity = PERSONAL
    return (c.contains("@") & c.rlike(email)) | (c.rlike(r"\p{Nd}{11}") & (c.rlike(phone) | c.rlike(identity)))


def first_letters(pattern: str) -> str | None:
    """The characters that a match of a pattern can begin with, as a class's inside; None unless every alternative begins with a letter."""
    folded = pattern.startswith("(?i)")
    depth, parts, body = 0, [""], pattern.removeprefix("(?i)")
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    if not all(p and p[0].isalpha() and p[1:2] not in ("?", "*", "{") for p in parts):
        return None
    return "".join(p[0].lower() + p[0].upper() if folded else p[0] for p in parts)


#: A group of plain alternatives that has to be there.
_CHOICE = re.compile(r"\((?:\?:)?([^()?*+.\[\]\\{}^$]+)\)(?![?*{])")


def needed(pattern: str) -> list[str] | None:
    """Literals of which a text holds one wherever the pattern is found; in lower case if the pattern ignores case. None if they aren't plain to see."""
    folded, body = pattern.startswith("(?i)"), pattern.removeprefix("(?i)")
    if m := _CHOICE.search(body):
        each = [needed("(?i)" * folded + body[: m.start()] + x + body[m.end() :]) for x in m[1].split("|")]
        return None if None in each else sorted({x for xs in each for x in xs})
    if re.search(r"[\\^$\[\]{}]|\(\?[^:=!<]", body):  # escapes, classes, counts, flags
        return None
    depth, parts, run = 0, [[]], ""
    for ch, after in zip(body, body[1:] + " "):
        depth += ch == "("
        plain = ch.isalnum() or ch in " ’'"
        if depth == 0 and plain and after not in "?*" and (ch.isascii() or not folded):
            run += ch
            continue
        parts[-1].append(run)
        run = ""
        depth -= ch == ")"
        if ch == "|" and depth == 0:
            parts.append([])
    parts[-1].append(run)
    best = [max(p, key=len).lower() if folded else max(p, key=len) for p in parts]
    return best if min(map(len, best)) > 1 else None


def matches_any(c: Column, patterns=REFUSALS) -> Column:
    """Whether one of the patterns is found: all in one pass, which tries them only where one can begin, and only in texts that hold a literal that one of them needs."""
    if not patterns:
        return F.lit(False)
    firsts = [first_letters(p) for p in patterns]
    ahead = "" if None in firsts else f"(?=[{''.join(firsts)}])"
    found = c.rlike(f"(?d){ahead}(?:{'|'.join(f'(?:{p})' for p in patterns)})")
    literals = [needed(p) for p in patterns]
    if None in literals:
        return found

    def some(text: Column, of: set[str]) -> Column:
        least = sorted(x for x in of if not any(y in x for y in of - {x}))
        return F.lit(False) if not least else reduce(or_, (text.contains(x) for x in least))

    exact = {x for p, xs in zip(patterns, literals) for x in xs if not p.startswith("(?i)")}
    folded = {x for p, xs in zip(patterns, literals) for x in xs if p.startswith("(?i)")}
    may = some(c, exact)
    if folded:  # a lambda, so that the text is put in lower case once
        may = may | F.exists(F.array(F.lower(c)), lambda low: some(low, folded))
    return may & found


def fingerprint(c: Column) -> Column:
    """The first 64 bits, as hex, of the MD5 of a text as a JSON string."""
    return F.substring(F.md5(F.regexp_replace(F.to_json(F.struct(c.alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")), 1, 16)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def last_json_array(c: Column, schema: str) -> Column:
    """The JSON array between a text's first [ and last ], parsed; null if there is none or it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit("")), schema)


def trim_overlap(existing: Column, new: Column) -> Column:
    """The new text without its longest beginning that the existing one ends with."""
    most = F.least(F.length(existing), F.length(new))
    sizes = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda n: F.substring(existing, F.length(existing) - n + 1, n) == F.substring(new, F.lit(1), n))
    return F.substring(new, F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0)) + 1, F.length(new))


def printable_part(c: Column) -> Column:
    """What of a growing text can be shown: all if it ends with a line feed or an ideograph, all but the last after an ideograph, else up to the last space."""
    to_space = F.length(c) - F.instr(F.reverse(c), " ") + 1
    upto = F.when(F.instr(c, " ") > 0, F.substring(c, F.lit(1), to_space)).otherwise(F.lit(""))
    return (
        F.when(c.endswith("\n"), c)
        .when(F.length(c) == 0, c)
        .when(is_script_char(F.substring(c, -1, 1)), c)
        .when((F.length(c) > 1) & is_script_char(F.substring(c, -2, 1)), F.substring(c, F.lit(1), F.length(c) - 1))
        .otherwise(upto)
    )


def remove_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def remove_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def cut_at(c: Column, stop: str) -> Column:
    """The text before the first occurrence of a stop string."""
    return F.substring_index(c, stop, 1)


def split_reasoning(c: Column, start: str = "<think>", end: str = "</think>") -> Column:
    """(reasoning, answer): the start tag goes; without an end tag everything is reasoning."""
    body = strip(F.replace(c, F.lit(start), F.lit("")))
    at = F.locate(end, body)
    return F.struct(
        F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body).alias("reasoning"),
        F.when(at > 0, strip(F.substring(body, at + len(end), F.length(body)))).otherwise(F.lit("")).alias("answer"),
    )


@F.pandas_udf(T.StringType())
def _call_list(s: pd.Series) -> pd.Series:
    """A list of Python calls with literal keyword arguments, as a JSON array; null for anything else."""

    def read(text):
        if not text.strip().startswith("["):
            return None
        try:
            body = ast.parse(text.strip(), mode="eval").body
            if not isinstance(body, ast.List) or not all(isinstance(x, ast.Call) and isinstance(x.func, ast.Name) for x in body.elts):
                return None
            return json.dumps([{"name": x.func.id, "arguments": {k.arg: ast.literal_eval(k.value) for k in x.keywords}} for x in body.elts])
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return s.map(read, na_action="ignore")


def tool_calls(c: Column) -> Column:
    """Calls in an answer, in any of the tagged JSON styles or as a list of Python calls: array of (name, arguments as JSON text)."""
    call = "struct<name:string,arguments:string,parameters:string>"
    tagged = F.regexp_extract_all(c, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    listed = F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\[TOOL_CALLS\]\s*(\[.*\])", 1), F.lit("")), f"array<{call}>")
    fenced = F.regexp_extract_all(c, F.lit(r"(?s)```json\s*(\{.*?\})\s*```"), F.lit(1))
    fenced_names = F.regexp_extract_all(c, F.lit(r"function<[^>]*>(\w+)\s*```json"), F.lit(1))
    python_tag = F.when(c.contains("<|python_tag|>"), F.split(F.substring_index(c, "<|python_tag|>", -1), r"(?<=\})\s*;\s*(?=\{)"))
    parsed = lambda xs: F.transform(xs, lambda x: F.from_json(x, call))
    named = F.transform(F.arrays_zip(fenced_names.alias("n"), fenced.alias("a")), lambda z: F.from_json(F.to_json(F.struct(z["n"].alias("name"), z["a"].alias("arguments"))), call))
    bare = F.when(F.ltrim(c).startswith("{"), F.array(c))
    pythonic = F.when(F.trim(c).rlike(r"(?s)^\[\s*[A-Za-z_]\w*\s*\(.*\)\s*\]$"), F.from_json(_call_list(c), f"array<{call}>"))
    found = F.coalesce(F.when(F.size(tagged) > 0, parsed(tagged)), listed, pythonic, F.when((F.size(fenced) > 0) & (F.size(fenced_names) > 0), named), parsed(python_tag), parsed(bare))
    kept = F.filter(found, lambda x: x["name"].isNotNull())
    return F.transform(F.coalesce(kept, F.array().cast(f"array<{call}>")), lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["arguments"], x["parameters"]).alias("arguments")))


def json_type(c: Column) -> Column:
    return F.get_json_object(c, "$.type")


def mentions_format(c: Column) -> Column:
    """Whether a JSON schema has a `format` key at any depth."""
    return c.rlike(r'"format"\s*:')


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def repaired_json(c: Column) -> Column:
    """Replacement characters and runs of control characters as spaces."""
    return F.regexp_replace(F.regexp_replace(c, "�", " "), r"[\x00-\x1f]+", " ")
