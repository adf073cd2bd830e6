"""Queries for training batches: masks, padding, packing, preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import tokens
from tessera.plans.conversations import _pairs
from tessera.plans.conversations import _PAIRS as PAIRS


def _coded(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "turn", tokens.code_points(F.col("human")).alias("p"), tokens.code_points(F.col("assistant")).alias("a"))


def _text(c):
    return F.md5(F.array_join(c.cast("array<string>"), ","))


def sft_mask_truncate(spark, sf_dir):
    m = _coded(spark, sf_dir).select("conv_id", "turn", tokens.masked(F.col("p"), F.col("a")).alias("m"))
    ids, mask = tokens.truncated(F.col("m.input_ids"), 64), tokens.truncated(F.col("m.target_mask"), 64)
    return m.select("conv_id", "turn", F.size(ids).alias("n"), F.aggregate(mask, F.lit(0), lambda x, y: x + y).alias("n_targets"), _text(tokens.labels(ids, mask)).alias("labels_md5"))


def next_token_shift(spark, sf_dir):
    m = _coded(spark, sf_dir).select("conv_id", "turn", tokens.masked(F.col("p"), F.col("a")).alias("m"))
    s = tokens.shifted(F.col("m.input_ids"), tokens.labels(F.col("m.input_ids"), F.col("m.target_mask")))
    return m.select("conv_id", "turn", _text(s["inputs"]).alias("inputs_md5"), _text(s["targets"]).alias("targets_md5"))


def pad_batch(spark, sf_dir):
    c = _coded(spark, sf_dir).select("conv_id", "turn", (F.col("conv_id") % 16).alias("batch"), F.col("a").alias("ids"))
    p = tokens.padded(c, "batch", "ids", 100)
    return p.select("conv_id", "turn", "batch", F.size("ids").alias("n"), F.aggregate("attention_mask", F.lit(0), lambda x, y: x + y).alias("n_real"), _text(F.col("ids")).alias("ids_md5"))


def pack_blocks(spark, sf_dir):
    c = _coded(spark, sf_dir).select((F.col("conv_id") % 8).alias("batch"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.col("a").alias("ids"))
    return tokens.packed(c, "batch", "at", "ids", 128).select("batch", "block_no", F.size("ids").alias("n"), _text(F.col("ids")).alias("ids_md5"))


def dpo_truncate(spark, sf_dir):
    c = _coded(spark, sf_dir)
    other = c.groupBy("conv_id").agg(F.max_by("p", "turn").alias("r"))
    x = c.join(other, "conv_id").select("conv_id", "turn", tokens.preference(F.col("p"), F.col("a"), F.col("r"), 96, 24).alias("d"))
    return x.select("conv_id", "turn", F.size("d.chosen_ids").alias("n_chosen"), F.size("d.rejected_ids").alias("n_rejected"), _text(F.col("d.chosen_labels")).alias("chosen_md5"), _text(F.col("d.rejected_labels")).alias("rejected_md5"))


def token_length_prune(spark, sf_dir):
    """Turns of 2 to 200 tokens."""
    return _coded(spark, sf_dir).where(F.size("a").between(2, 200)).select("conv_id", "turn", F.size("a").alias("n"))


QUERIES = {f.__name__: f for f in (sft_mask_truncate, next_token_shift, pad_batch, pack_blocks, dpo_truncate, token_length_prune)}

_IDS = "list_transform(regexp_extract_all({c}, '[^ \\n]+'), lambda w: ('0x' || substr(md5(w), 1, 6))::INTEGER)"
_CODED = f"(SELECT conv_id, turn, {_IDS.format(c='human')} AS p, {_IDS.format(c='assistant')} AS a FROM {PAIRS})"
_T = "md5(array_to_string({}, ','))"
_REP = "list_transform(range({n}), lambda x: {v})"
_LAB = f"list_concat({_REP.format(n='len(p)', v='-100')}, a)"

ORACLES = {
    "sft_mask_truncate": f"SELECT conv_id, turn, least(64, len(p) + len(a))::INTEGER AS n, greatest(0, least(64, len(p) + len(a)) - len(p))::INTEGER AS n_targets, {_T.format(_LAB + '[:64]')} AS labels_md5 FROM {_CODED}",
    "next_token_shift": f"SELECT conv_id, turn, {_T.format('list_concat(p, a)[:-2]')} AS inputs_md5, {_T.format(_LAB + '[2:]')} AS targets_md5 FROM {_CODED}",
    "pad_batch": f"""
        WITH b AS (SELECT conv_id, turn, conv_id % 16 AS batch, a[:100] AS a, least(100, max(len(a)) OVER (PARTITION BY conv_id % 16)) AS m FROM {_CODED})
        SELECT conv_id, turn, batch, m::INTEGER AS n, len(a)::INTEGER AS n_real, {_T.format("list_concat(a, " + _REP.format(n="m - len(a)", v="0") + ")")} AS ids_md5 FROM b""",
    "pack_blocks": f"""
        WITH t AS (SELECT conv_id % 8 AS batch, flatten(list(a ORDER BY conv_id * 1000 + turn)) AS ids FROM {_CODED} GROUP BY 1)
        SELECT batch, k AS block_no, len(ids[k * 128 + 1:k * 128 + 128])::INTEGER AS n, {_T.format("ids[k * 128 + 1:k * 128 + 128]")} AS ids_md5
        FROM (SELECT batch, ids, unnest(range(greatest(1, len(ids) // 128))) AS k FROM t WHERE len(ids) > 0)""",
    "dpo_truncate": f"""
        WITH c AS {_CODED}, o AS (SELECT conv_id, arg_max(p, turn) AS r FROM c GROUP BY 1),
        x AS (SELECT conv_id, turn, p AS p0, a, r, greatest(len(a), len(r)) AS g, len(p) + greatest(len(a), len(r)) > 96 AS over FROM c JOIN o USING (conv_id)),
        y AS (SELECT *, CASE WHEN over THEN p0[greatest(1, len(p0) - greatest(24, 96 - g) + 1):] ELSE p0 END AS p FROM x),
        z AS (SELECT conv_id, turn, p, CASE WHEN over THEN a[:greatest(0, 96 - len(p))] ELSE a END AS a, CASE WHEN over THEN r[:greatest(0, 96 - len(p))] ELSE r END AS r FROM y)
        SELECT conv_id, turn, (len(p) + len(a))::INTEGER AS n_chosen, (len(p) + len(r))::INTEGER AS n_rejected, {_T.format(_LAB)} AS chosen_md5, {_T.format(_LAB.replace(", a)", ", r)"))} AS rejected_md5 FROM z""",
    "token_length_prune": f"SELECT conv_id, turn, len(a)::INTEGER AS n FROM {_CODED} WHERE len(a) BETWEEN 2 AND 200",
}
