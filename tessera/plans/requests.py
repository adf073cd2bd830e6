"""Queries over requests and sources on literal lines: load-test builders, curation modes, question lists, tool calls, log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import answers, text
from tessera.operators import curate, requests


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _words(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.split("text", " ").alias("w"))


def random_requests(spark, sf_dir):
    """Each benchmark item's words cut or repeated to a drawn length, and a drawn output length."""
    b = _words(spark, sf_dir).withColumn("n", requests.drawn_length(F.col("item_id"), 200, 0.25, 1))
    return b.select("item_id", "n", requests.drawn_length(F.col("item_id"), 64, 0.5, 2).alias("output_len"), F.md5(F.array_join(requests.of_length(F.col("w"), F.col("n")), " ")).alias("md5"))


def counting_requests(spark, sf_dir):
    """Token lists that count up from a drawn offset."""
    b = _words(spark, sf_dir).withColumn("n", requests.drawn_length(F.col("item_id"), 40, 0.1, 3)).withColumn("offset", requests.drawn_int(F.col("item_id"), 0, 1000, 4))
    return b.select("item_id", F.array_join(requests.counting_tokens(F.col("offset"), F.col("item_id"), F.col("n"), 1000), ",").alias("tokens"))


def recycled_requests(spark, sf_dir):
    """Short turns of user-led conversations, recycled until there are two and a half times as many requests as turns."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' AND length(text) < 400").select("conv_id", "turn")
    n = t.count() * 5 // 2
    return requests.recycled(t, ["conv_id", "turn"], n).select("request", "conv_id", "turn")


def longest_output_first(spark, sf_dir):
    b = _words(spark, sf_dir).select("item_id", requests.drawn_length(F.col("item_id"), 64, 0.1, 5).alias("output_len"))
    return requests.longest_first(b, "output_len", "item_id")


def batch_latency(spark, sf_dir):
    """Events of a user as the steps of a run: the first is the prefill."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") % 5).alias("step"), (F.abs(F.round("value", 2)) + 0.1).alias("s"))
    b = requests.batch_latency(e, "user_id", "step", "s", F.lit(8), F.lit(128), F.lit(32))
    return b.select("user_id", *[F.round(c, 6).alias(c) for c in ("prefill_throughput", "median_decode_latency", "overall_throughput")])


def curation_modes(spark, sf_dir):
    """Sizes of the corpus without the filter, and without filter and deduplication: repeated texts go, or are drawn again."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", "domain").otherwise("general").alias("source"), F.when(F.col("source") == "src0", 0).otherwise(1).alias("rank"), "text")
    n = d.where("length(text) > 0").count()  # null and empty texts are in no corpus
    some = lambda mode, total, **more: curate.curated(d, {"domain": 0.4, "general": 0.6}, total, F.lit(True), filtering=False, **more).agg(F.count("*").alias("n"), F.countDistinct("fp").alias("texts")).select(F.lit(mode).alias("mode"), "n", "texts")
    return some("no_filter", 2 * n, near=None).union(some("no_filter_no_dedup", n + 100, deduplicating=False))


def tool_calls(spark, sf_dir):
    """Calls in answers of four styles, with separators and brackets inside their texts."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.concat(F.lit("a;b} "), F.col("item_id").cast("string")).alias("arg"))
    one = F.concat(F.lit('{"name": "f", "arguments": {"q": "'), "arg", F.lit('"}}'))
    said = F.element_at(F.array(F.concat(F.lit("<tool_call>\n"), one, F.lit("\n</tool_call>")), F.concat(F.lit("[TOOL_CALLS] ["), one, F.lit("]")), F.concat(F.lit("<|python_tag|>"), one, F.lit("; "), one), F.concat(F.lit('[f(q="'), "arg", F.lit('"), g(n=2)]'))), (F.col("item_id") % 4 + 1).cast("int"))
    calls = b.select("item_id", text.tool_calls(said).alias("c"))
    return calls.select("item_id", F.size("c").alias("n"), F.get("c", F.lit(0))["name"].alias("name"), F.get_json_object(F.get("c", F.lit(0))["arguments"], "$.q").alias("q"))


def token_logprobs(spark, sf_dir):
    """Parallel arrays of tokens and log-probabilities, and a map by token, of which the last of a text wins."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x, i: F.struct(F.round(x.cast("double"), 4).alias("logprob"), i.alias("id"), F.concat(F.lit("t"), (i % 7).cast("string")).alias("text"))).alias("e"))
    r = v.select("vec_id", answers.logprob_arrays(F.col("e")).alias("r"))
    return r.select("vec_id", F.md5(F.array_join("r.tokens", ",")).alias("tokens_md5"), F.size("r.logprobs").alias("n"), F.element_at("r.by_text", F.lit("t3")).alias("last_t3"), F.size("r.by_text").alias("texts"))


QUERIES = {f.__name__: f for f in (random_requests, counting_requests, recycled_requests, longest_output_first, batch_latency, curation_modes, tool_calls, token_logprobs)}

_DRAWN = lambda key, low, high, seed: f"(('0x' || substr(md5('{seed}|' || {key}::VARCHAR), 1, 8))::BIGINT % {high - low} + {low})::INTEGER"

ORACLES = {
    "random_requests": f"""
        WITH b AS (SELECT item_id, string_split(text, ' ') AS w, {_DRAWN("item_id", 50, 201, 1)} AS n, {_DRAWN("item_id", 32, 65, 2)} AS output_len FROM benchmark)
        SELECT item_id, n, output_len, md5(array_to_string([w[(i % len(w)) + 1] FOR i IN range(n)], ' ')) AS md5 FROM b""",
    "counting_requests": f"""
        WITH b AS (SELECT item_id, {_DRAWN("item_id", 4, 41, 3)} AS n, {_DRAWN("item_id", 0, 1000, 4)} AS o FROM benchmark)
        SELECT item_id, array_to_string([(o + item_id + j) % 1000 FOR j IN range(n)], ',') AS tokens FROM b""",
    "recycled_requests": """
        WITH t AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM conversations WHERE role = 'user' AND length(text) < 400)
        SELECT i + k * n AS request, conv_id, turn FROM t, range(3) r(k) WHERE i + k * n < n * 5 // 2""",
    "longest_output_first": f"SELECT item_id, output_len, row_number() OVER (ORDER BY output_len DESC, item_id) AS place FROM (SELECT item_id, {_DRAWN('item_id', 6, 65, 5)} AS output_len FROM benchmark)",
    "batch_latency": """
        WITH e AS (SELECT user_id, event_id % 5 AS step, abs(round(value, 2)) + 0.1::DOUBLE AS s FROM events)
        SELECT user_id, round(1024 / sum(s) FILTER (step = 0), 6) AS prefill_throughput, round(quantile_cont(s, 0.5) FILTER (step > 0), 6) AS median_decode_latency,
               round(1280 / sum(s), 6) AS overall_throughput FROM e GROUP BY 1""",
    "curation_modes": """
        SELECT 'no_filter' AS mode, count(DISTINCT text) AS n, count(DISTINCT text) AS texts FROM documents WHERE length(text) > 0
        UNION ALL SELECT 'no_filter_no_dedup', count(*) + 100, count(DISTINCT text) FROM documents WHERE length(text) > 0""",
    "tool_calls": "SELECT item_id, CASE WHEN item_id % 4 >= 2 THEN 2 ELSE 1 END AS n, 'f' AS name, 'a;b} ' || item_id::VARCHAR AS q FROM benchmark",
    "token_logprobs": """
        SELECT vec_id, md5(array_to_string(['t' || (i % 7)::VARCHAR FOR i IN range(len(embedding))], ',')) AS tokens_md5, len(embedding)::INTEGER AS n,
               round(embedding[((len(embedding) - 4) // 7) * 7 + 4]::DOUBLE, 4) AS last_t3, 7 AS texts FROM embeddings""",
}
