"""Token sequences: masks, truncation, padding, packing, preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def code_points(c: Column) -> Column:
    """A stand-in tokenizer: a text's words as numbers, the first 6 hex digits of their MD5."""
    words = F.regexp_extract_all(c, F.lit(r"([^ \n]+)"), F.lit(1))
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))


def masked(prompt: Column, answer: Column) -> Column:
    """(input_ids, target_mask): 0 on the prompt, 1 on the answer."""
    zeros, ones = F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(answer))
    return F.struct(F.concat(prompt, answer).alias("input_ids"), F.concat(zeros, ones).alias("target_mask"))


def truncated(c: Column, most: int) -> Column:
    return F.slice(c, 1, most)


def labels(ids: Column, mask: Column) -> Column:
    """Ids where the mask is 1, else -100."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))


def shifted(ids: Column, labels: Column) -> Column:
    """Each token with the label after it."""
    n = F.size(ids) - 1
    ok = F.size(ids) > 1
    none = F.array().cast("array<int>")
    return F.struct(F.when(ok, F.slice(ids, F.lit(1), n)).otherwise(none).alias("inputs"), F.when(ok, F.slice(labels, F.lit(2), n)).otherwise(none).alias("targets"))


def padded(df: DataFrame, batch: str, ids: str, most: int, pad: int = 0) -> DataFrame:
    """Pads each row to its batch's longest, `most` at most; adds attention_mask and replaces ids."""
    longest = F.least(F.lit(most), F.max(F.size(ids)).over(Window.partitionBy(batch)))
    kept = F.slice(ids, F.lit(1), F.col("_n"))
    fill = lambda v: F.array_repeat(F.lit(v), F.greatest(F.lit(0), F.col("_n") - F.size(kept)))
    df = df.withColumn("_n", longest)
    df = df.withColumn("attention_mask", F.concat(F.transform(kept, lambda _: F.lit(1)), fill(0)))
    return df.withColumn(ids, F.concat(kept, fill(pad))).drop("_n")


def packed(df: DataFrame, group: str, order: str, ids: str, block: int) -> DataFrame:
    """(group, block_no, ids): a group's tokens one after another in blocks of a fixed length.

    What is left over goes only if the group fills a block. A group is the unit that is concatenated, as one map batch
    is; its tokens are split at block borders by place, so no task holds more than a block's worth of rows together.
    """
    w = Window.partitionBy(group).orderBy(order)
    total = F.sum(F.size(ids)).over(Window.partitionBy(group))
    placed = df.withColumn("_start", F.coalesce(F.sum(F.size(ids)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", total).where(F.size(ids) > 0)
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.size(ids) - 1) / block)
    parts = placed.select(group, "_start", "_total", ids, F.explode(F.sequence(first, last)).alias("block_no"))
    begin = F.greatest(F.lit(0), F.col("block_no") * block - F.col("_start"))
    end = F.least(F.size(ids), (F.col("block_no") + 1) * block - F.col("_start"))
    parts = parts.select(group, "block_no", "_start", "_total", F.slice(ids, (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    whole = (F.col("block_no") < F.floor(F.col("_total") / block)) | (F.col("_total") < block)
    out = parts.where(whole).groupBy(group, "block_no").agg(F.array_sort(F.collect_list(F.struct("_start", "part"))).alias("p"))
    return out.select(group, "block_no", F.flatten(F.transform("p", lambda x: x["part"])).alias("ids"))


def preference(prompt: Column, chosen: Column, rejected: Column, most: int, most_prompt: int) -> Column:
    """Prompt cut from the left to max(most_prompt, most - the longer answer), then answers cut to what is left; labels -100 on the prompt."""
    longer = F.greatest(F.size(chosen), F.size(rejected))
    room = F.greatest(F.lit(most_prompt), most - longer)
    p = F.when(F.size(prompt) + longer > most, F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), room)).otherwise(prompt)
    left = F.greatest(F.lit(0), most - F.size(p))
    one = lambda a: F.when(F.size(p) + longer > most, F.slice(a, F.lit(1), left)).otherwise(a)
    lab = lambda a: F.concat(F.transform(p, lambda _: F.lit(IGNORED)), one(a))
    return F.struct(F.concat(p, one(chosen)).alias("chosen_ids"), lab(chosen).alias("chosen_labels"), F.concat(p, one(rejected)).alias("rejected_ids"), lab(rejected).alias("rejected_labels"))
