"""A training corpus from `documents`: language, lines, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
that they were given, extra ones of any name included. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, language, lines, mixing
from tessera.llm.common import Scratch, fresh

#: Documents whose language scores less are rejected. Ordinary texts score above 0.5.
LEAST_SCORE = 0.25
VOCABULARY = "byte_bpe_50k.json"


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts among them, and those of no language to speak of; fills in a missing lang.

    Each row is judged by its text alone, so rows that repeat stay or go together.
    """
    columns, (found, score) = docs.columns, fresh(docs, 2)
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = language.identify(docs, model, lang=found, score=score)
    kept = out.where((F.col(found) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", found)).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike, in a document or across documents, one stays; documents left without any go.

    Null texts and texts without a letter or digit have nothing to lose and stay. Rows that repeat doc_id and text are
    one document here: they lose the same lines.
    """
    return _counted(lines.dedup(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more.

    It is that of the least doc_id, then hash of its text. Of rows that repeat doc_id and text, the one whose other
    columns come first as JSON stays. Texts without words, null ones too, link with nothing.
    """
    k, rank = fresh(docs, 2)
    name = F.struct("doc_id", F.xxhash64("text").alias("th")).alias(k)
    linked = jaccard.link(docs.select(name, "text"), key=k, width=5, percent=80)
    keep = linked.where(F.col("component_id").eqNullSafe(F.col(k))).select(k).distinct()
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    out = docs.select("*", name).join(keep, k, "left_semi")
    out = out.withColumn(rank, F.row_number().over(Window.partitionBy(k).orderBy(F.to_json(F.struct(*others)))))
    return out.where(F.col(rank) == 1).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that takes a document; one that the budget's end cuts counts if half of it or more is taken.

    Documents without words, null texts too, take no part and go. Rows that repeat doc_id and text get as many copies
    as all of them take, shared evenly and rounded up.
    """
    k, copies, copy = fresh(docs, 3)
    name = F.struct("doc_id", F.xxhash64("text").alias("th")).alias(k)
    mixed = mixing.mix(docs.select("doc_id", "source", "text", name), keep=(k,))
    whole = F.size(F.filter("pass_words", lambda w: (w > 0) & (2 * w >= F.col("size"))))
    taken = mixed.groupBy(k).agg(F.ceil(F.sum(whole) / F.count("*")).cast("int").alias(copies)).where(F.col(copies) > 0)
    out = docs.select("*", name).join(taken, k)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding the ids gives the text again; a null text counts as empty."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary), vocabulary)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder as Parquet and read again; a stage's table goes when the next is written."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


#: SQL can't express a language model or byte-pair merges.
ORACLE_SQL = None
