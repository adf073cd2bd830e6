"""Queries over request logs, vectors and caches: latency statistics, rankings, prefix matches, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import chains, latency, ranking
from tessera.operators.sequence import running_sum


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _requests(spark, sf_dir):
    """The event log read as requests: latency, time to first token and output length from an event's value and key."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value", (F.abs("value") + 0.1).alias("latency"), ((F.abs("value") + 0.1) * 0.25).alias("ttft"), (k % 20 + 1).alias("output_len"), (k % 13 != 0).alias("success"))


def latency_stats(spark, sf_dir):
    r = _requests(spark, sf_dir).where("success").withColumn("tpot", latency.tpot(F.col("latency"), F.col("ttft"), F.col("output_len")))
    return r.groupBy("event_type").agg(F.count("*").alias("completed"), F.sum("output_len").alias("output_tokens"), *latency.statistics(F.col("latency"), "e2e", 8), *latency.statistics(F.col("ttft"), "ttft", 8), *latency.statistics(F.col("tpot"), "tpot", 8))


def throughput(spark, sf_dir):
    r = _requests(spark, sf_dir)
    wall = F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 - F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return r.agg(F.count_if("success").alias("completed"), F.round(F.sum("output_len") / wall, 6).alias("tokens_per_s"), F.round(F.sum("latency") / wall, 6).alias("concurrency"), F.round(F.try_divide(F.sum("output_len") / wall, F.max("output_len")), 6).alias("per_user"))


def latency_histogram(spark, sf_dir):
    h = latency.histogram(_requests(spark, sf_dir), "latency", latency.E2E)
    return h.select(F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "count", "cumulative")


def weighted_histogram(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn("gap", F.col("latency") / F.col("output_len"))
    h = latency.histogram(r, "gap", latency.ITL, F.col("output_len"))
    return h.select(F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "count", "cumulative")


def counters(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.groupBy("event_type").agg(F.sum("output_len").alias("generated"), F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("aborted"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


def rolling_mean(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("event_id", *[F.round(latency.rolling_mean("value", n, "event_type", ["ts", "event_id"]), 9).alias(f"mean_{n}") for n in (5, 50)])


def inter_event_gap(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    g = latency.gaps(r, "user_id", "at", ["ts", "event_id"], F.col("output_len"))
    return g.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("gap"), 0).cast("long").alias("total"))


def poisson_arrivals(spark, sf_dir):
    return latency.poisson_arrivals(_requests(spark, sf_dir).select("event_id"), "event_id", 4.0).select("event_id", F.round("gap", 6).alias("gap"), F.round("arrival", 3).alias("arrival"))


def topk_components(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return ranking.top_k(v, "vec_id", "x", 3, "place").select("vec_id", "place", "rank")


def topk_neighbours(spark, sf_dir):
    """The three vectors of largest dot product with each whose id is divisible by 100."""
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("e"))
    return ranking.nearest(v.where("id % 100 = 0"), v, 3)


def nucleus_filter(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("place", "x")).withColumn("e", F.round(F.abs(F.col("x").cast("double")), 4))
    p = v.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("vec_id")))
    return ranking.nucleus(p, "vec_id", "p", "place", 20, 0.5, 0.05).select("vec_id", "place", "rank", F.round("kept_p", 5).alias("kept_p"))


def penalties(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 10).alias("u")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("logit"))
    return e.select("event_type", "u", F.round(ranking.penalised(F.col("logit"), F.col("n"), 0.5, 2.0, F.lit(False), F.lit(1), 0), 2).alias("logit"), (ranking.penalised(F.col("logit"), F.col("n"), 0.5, 2.0, F.col("u") == 0, F.lit(1), 4) == float("-inf")).alias("blocked"))


def _matched(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("key"), "source")
    return ranking.longest_prefix(d.where("source <> 'src0'"), d.where("source = 'src0'"), "doc_id", "key", page=64)


def longest_prefix_match(spark, sf_dir):
    """The longest prefix, in pages of 64 characters, that each document shares with one of the largest source."""
    return _matched(spark, sf_dir).withColumn("stored_id", F.coalesce("stored_id", F.lit(-1)))


def prefix_schedule(spark, sf_dir):
    return ranking.schedule_order(_matched(spark, sf_dir), "matched", "doc_id", queue_limit=10**12, deprioritised=F.col("doc_id") % 10 == 0).select("doc_id", "matched", "place")


def redirect_chain(spark, sf_dir):
    """Links from each line to another, followed to their end."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    g = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).otherwise(F.floor(F.col("doc_id") / 2)).cast("long").alias("to"))
    return chains.resolved(g).groupBy("hops").agg(F.count("*").alias("n"), F.countDistinct("end").alias("ends"))


def scatter_add(spark, sf_dir):
    """Counts of physical units summed by the logical unit that each stands for, and each layer's balance."""
    m = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("unit"), (F.col("p_partkey") % 16).alias("logical"), (F.col("p_partkey") % 4).alias("layer"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("unit"))
    each = li.join(m, "unit").groupBy("layer", "logical").agg(F.count("*").alias("n"))
    return each.groupBy("layer").agg(F.sum("n").alias("n"), F.round((F.avg("n") + 1e-5) / (F.max("n") + 1e-5), 6).alias("balance"))


def tenant_sizes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = d.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.max("doc_id").alias("latest"))
    return each.agg(F.min_by("source", F.struct("chars", "source")).alias("smallest"), F.sum("chars").alias("chars"))


def lru_eviction(spark, sf_dir):
    """Entries least lately used, until a number of characters is freed."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", F.md5(F.col("doc_id").cast("string")).alias("used"))
    return running_sum(d, ["used", "doc_id"], "n_chars", "upto").where("upto - n_chars < 50000").select("doc_id", "n_chars")


def expert_packing(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 8).alias("item")).agg(F.count("*").cast("double").alias("weight"))
    return ranking.balanced_packs(e, "event_type", "item", "weight", 4).select("event_type", "item", "pack", "place")


def expert_replicas(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 8).alias("item")).agg(F.count("*").cast("double").alias("weight"))
    return ranking.replicated(e, "event_type", "item", "weight", 4).select("event_type", "item", "replicas")


def routing(spark, sf_dir):
    r = _requests(spark, sf_dir).select("event_id", (F.col("event_id") % 7 / 7.0).alias("rate"), (F.col("event_id") % 4).alias("matched"), (F.col("event_id") % 40).alias("low"), (F.col("event_id") % 90).alias("high"))
    to = ranking.cache_aware_route(F.col("rate"), F.col("matched"), F.lit(9).cast("long"), F.lit(5).cast("long"), F.col("low"), F.col("high"))
    return r.groupBy(to.alias("worker"), ranking.two_choices(F.col("low"), F.col("high"), F.lit("a"), F.lit("b")).alias("choice"), F.pmod("event_id", F.lit(3)).alias("round_robin")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (latency_stats, throughput, latency_histogram, weighted_histogram, counters, rolling_mean, inter_event_gap, poisson_arrivals, topk_components, topk_neighbours, nucleus_filter, penalties, longest_prefix_match, prefix_schedule, redirect_chain, scatter_add, tenant_sizes, lru_eviction, expert_packing, expert_replicas, routing)}

_R = """(SELECT *, abs(value) + 0.1::DOUBLE AS latency, (abs(value) + 0.1::DOUBLE) * 0.25::DOUBLE AS ttft, json_extract_string(props, '$.k')::INT % 20 + 1 AS output_len,
    json_extract_string(props, '$.k')::INT % 13 <> 0 AS success FROM events)"""
_STATS = lambda c, n: f"round(avg({c}), 8) AS mean_{n}, round(quantile_cont({c}, 0.5), 8) AS median_{n}, round(stddev_pop({c}), 8) AS std_{n}, round(quantile_cont({c}, 0.95), 8) AS p95_{n}, round(quantile_cont({c}, 0.99), 8) AS p99_{n}, round(max({c}), 8) AS max_{n}"


def _hist(value: str, bounds, weight: str) -> str:
    edges = ", ".join(f"({float(b)}::DOUBLE)" for b in bounds)
    return f"""
        WITH e AS (SELECT b FROM (VALUES {edges}, ('inf'::DOUBLE)) v(b)), r AS (SELECT {value} AS v, {weight} AS w FROM {_R}),
        c AS (SELECT (SELECT min(b) FROM e WHERE b >= v) AS le, sum(w)::BIGINT AS n FROM r GROUP BY 1)
        SELECT CASE WHEN b = 'inf'::DOUBLE THEN -1.0::DOUBLE ELSE b END AS le, coalesce(n, 0) AS count, sum(coalesce(n, 0)) OVER (ORDER BY b)::BIGINT AS cumulative FROM e LEFT JOIN c ON b = le"""


_PREFIX = """(
    WITH k AS (SELECT doc_id, source, md5(substr(text, 1, 64 * k)) AS h, k FROM documents, range(1, 2000) r(k) WHERE length(text) >= 64 * k),
    s AS (SELECT k, h, min(doc_id) AS s FROM k WHERE source = 'src0' GROUP BY 1, 2)
    SELECT d.doc_id, coalesce(max(m.k), 0)::BIGINT * 64 AS matched, arg_max(m.s, m.k) AS stored_id
    FROM documents d LEFT JOIN (SELECT k.doc_id, k.k, s.s FROM k JOIN s ON s.k = k.k AND s.h = k.h) m ON m.doc_id = d.doc_id WHERE d.source <> 'src0' GROUP BY 1)"""

ORACLES = {
    "latency_stats": f"SELECT event_type, count(*) AS completed, sum(output_len)::BIGINT AS output_tokens, {_STATS('latency', 'e2e')}, {_STATS('ttft', 'ttft')}, {_STATS('CASE WHEN output_len > 1 THEN (latency - ttft) / (output_len - 1) END', 'tpot')} FROM {_R} WHERE success GROUP BY 1",
    "throughput": f"""
        WITH w AS (SELECT count(*) FILTER (success) AS completed, sum(output_len) AS t, sum(latency) AS l, max(output_len) AS m, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS wall FROM {_R})
        SELECT completed, round(t / wall, 6) AS tokens_per_s, round(l / wall, 6) AS concurrency, round(t / wall / m, 6) AS per_user FROM w""",
    "latency_histogram": _hist("latency", latency.E2E, "1"),
    "weighted_histogram": _hist("latency / output_len", latency.ITL, "output_len"),
    "counters": f"SELECT event_type, sum(output_len)::BIGINT AS generated, count(*) AS requests, count(*) FILTER (NOT success) AS aborted, arg_max(event_id, epoch_us(ts)::HUGEINT * 10000000 + event_id) AS latest FROM {_R} GROUP BY 1",
    "rolling_mean": "SELECT event_id, " + ", ".join(f"round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 9) AS mean_{n}" for n in (5, 50)) + " FROM events",
    "inter_event_gap": f"""
        SELECT user_id, sum(output_len)::BIGINT AS n, round(sum(g), 0)::BIGINT AS total FROM (
            SELECT user_id, output_len, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM {_R}) WHERE g IS NOT NULL GROUP BY 1""",
    "poisson_arrivals": """
        WITH u AS (SELECT event_id, (('0x' || substr(md5(event_id::VARCHAR || '|0'), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM events)
        SELECT event_id, round(-ln(1 - u) / 4.0::DOUBLE, 6) AS gap, round(sum(-ln(1 - u) / 4.0::DOUBLE) OVER (ORDER BY event_id), 3) AS arrival FROM u""",
    "topk_components": """
        SELECT vec_id, (i - 1)::INTEGER AS place, r::INTEGER AS rank FROM (
            SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) WHERE r <= 3""",
    "topk_neighbours": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: round(p[1] * p[2] * 1e6)::BIGINT))::BIGINT AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 3""",
    "penalties": """
        WITH e AS (SELECT event_type, user_id % 10 AS u, count(*) AS n, round(sum(value), 2) AS logit FROM events GROUP BY 1, 2)
        SELECT event_type, u, round(logit - 0.5::DOUBLE * n - 2.0::DOUBLE, 2) AS logit, u = 0 AS blocked FROM e""",
    "longest_prefix_match": f"SELECT doc_id, matched, coalesce(stored_id, -1) AS stored_id FROM {_PREFIX}",
    "prefix_schedule": f"SELECT doc_id, matched, row_number() OVER (ORDER BY doc_id % 10 = 0, matched DESC, doc_id) AS place FROM {_PREFIX}",
    "redirect_chain": """
        WITH RECURSIVE g AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE doc_id // 2 END AS t FROM documents),
        c AS (SELECT doc_id, doc_id AS p, 0 AS hops FROM g UNION ALL SELECT c.doc_id, g.t, hops + 1 FROM c JOIN g ON g.doc_id = c.p WHERE g.t <> c.p),
        e AS (SELECT doc_id, max(hops) AS hops, arg_max(p, hops) AS t FROM c GROUP BY 1)
        SELECT hops, count(*) AS n, count(DISTINCT t) AS ends FROM e GROUP BY 1""",
    "scatter_add": """
        WITH e AS (SELECT l_partkey % 4 AS layer, l_partkey % 16 AS logical, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
        SELECT layer, sum(n)::BIGINT AS n, round((avg(n) + 0.00001::DOUBLE) / (max(n) + 0.00001::DOUBLE), 6) AS balance FROM e GROUP BY 1""",
    "tenant_sizes": "SELECT arg_min(source, lpad(c::VARCHAR, 20, '0') || source) AS smallest, sum(c)::BIGINT AS chars FROM (SELECT source, sum(n_chars) AS c FROM documents GROUP BY 1)",
    "lru_eviction": """
        SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 50000""",
    "routing": """
        WITH r AS (SELECT event_id, event_id % 7 / 7.0::DOUBLE AS rate, event_id % 4 AS matched, event_id % 40 AS low, event_id % 90 AS high FROM events)
        SELECT CASE WHEN high - low > 32 AND high > 1.0001::DOUBLE * low THEN 9 WHEN rate > 0.5 THEN matched ELSE 5 END AS worker, CASE WHEN low <= high THEN 'a' ELSE 'b' END AS choice, event_id % 3 AS round_robin, count(*) AS n FROM r GROUP BY 1, 2, 3""",
}
