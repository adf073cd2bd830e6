"""Record filters that name the first rule a record breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx


def judged(
    df: DataFrame, output: str, instruction: str | None = None, input: str | None = None, script: str = "han", least_ratio: float = 0.65,
    lengths=((0, 10**9), (0, 10**9), (0, 10**9)), most_urls: int = 5, patterns=tx.REFUSALS, drop_pii: bool = True, optional_input: bool = True, normalise=tx.squeeze,
) -> DataFrame:
    """Adds ins_norm, in_norm, out_norm and reject_reason: empty, ratio, length, pattern, urls, pii, or null.

    Rules are tried in that order, the cheap ones first. The input is checked only if it isn't empty, unless
    `optional_input` is off. Patterns apply to the output alone. `normalise` is computed once: what a generator makes
    isn't repeated in the rules and filters above it.
    """
    col = lambda name: normalise(F.coalesce(F.col(name), F.lit(""))) if name else F.lit("")
    norms = F.struct(col(instruction).alias("ins_norm"), col(input).alias("in_norm"), col(output).alias("out_norm"))
    df = df.select("*", F.inline(F.array(norms)))
    ins, inp, out = F.col("ins_norm"), F.col("in_norm"), F.col("out_norm")
    asked = (F.length(inp) > 0) if optional_input else F.lit(True)
    parts = [(out, lengths[2], F.lit(True))]
    if instruction:
        parts.append((ins, lengths[0], F.lit(True)))
    if input:
        parts.append((inp, lengths[1], asked))

    def some(test) -> Column:
        hit = F.lit(False)
        for c, bounds, when in parts:
            hit = hit | (when & test(c, bounds))
        return hit

    reason = F.when((F.length(out) == 0) | ((F.length(ins) == 0) if instruction else F.lit(False)), "empty")
    reason = reason.when(some(lambda c, _: tx.script_ratio(c, script) < least_ratio), "ratio")
    reason = reason.when(some(lambda c, b: ~F.length(c).between(*b)), "length")
    reason = reason.when(tx.matches_any(out, patterns), "pattern")
    reason = reason.when(some(lambda c, _: tx.url_count(c) > most_urls), "urls")
    if drop_pii:
        reason = reason.when(some(lambda c, _: tx.has_pii(c)), "pii")
    return df.withColumn("reject_reason", reason)


def generated_ok(ins: Column, inp: Column, out: Column) -> Column:
    """The rule for generated items: stripped lengths, basic ideographs for at least 0.6 of each part, no bad phrase."""
    ok = tx.length_ok(ins, 20, 200, True) & tx.length_ok(inp, 20, 300, True) & tx.length_ok(out, 80, 1200, True)
    for c in (ins, inp, out):
        ok = ok & tx.script_ratio_ok(tx.strip(c))
    return ok & ~tx.matches_any(out, tx.BAD_PHRASES)


def present(df: DataFrame, *columns: str) -> DataFrame:
    """The rows without a null in these columns."""
    return df.dropna(subset=list(columns))


def is_large(width: Column, height: Column, limit: int) -> Column:
    """Whether an image has so many pixels or more; false where a side isn't known."""
    return F.coalesce(width.cast("long") * height.cast("long") >= limit, F.lit(False))


def large_share(width: Column, height: Column, limit: int) -> list[Column]:
    """skipped, and its percentage of all rows to two places: aggregates."""
    skipped = F.count_if(is_large(width, height, limit))
    return [skipped.alias("skipped"), F.round(100.0 * skipped / F.count(F.lit(1)), 2).alias("percent")]
