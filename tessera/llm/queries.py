"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, language, licenses, lines, media, mixing, personal_data, sharding, vector_search
from tessera.llm.common import table


def op8_wfq_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector_search.quantise(F.col("embedding")).alias("v"))
    return vector_search.top_k(v, v.where("id % 50 = 0"))


def op3_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.learn(docs.where(~F.col("held_out")))
    found = language.identify(docs.select("doc_id", "held_out", "text"), model, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.listed("base").cast("binary"), 256).alias("base_sha256"), personal_data.listed("spans").alias("spans"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.classes(media.gallery(table(spark, sf_dir, "embeddings")))


QUERIES = {"op7_image_copies": op7_image_copies, "op2_license_scan": op2_license_scan, "op5_line_dedup": op5_line_dedup, "op4_jaccard_join": op4_jaccard_join, "op10_pii": op10_pii, "op9_language_id": op9_language_id, "op6_bpe": op6_bpe, "op1_va_file_topk": op1_va_file_topk, "op3_label_propagation_shards": op3_label_propagation_shards, "op8_wfq_mix": op8_wfq_mix}
ORACLES = {"op1_va_file_topk": vector_search.ORACLE, "op8_wfq_mix": mixing.ORACLE}
