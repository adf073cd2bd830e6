"""Queries over the star schema and event table: scans, joins, aggregates, windows. Built-ins, offered beside the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import models
from tessera.streaming import streams


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing_summary(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    cents = lambda c: F.round(c * 100).cast("long")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(cents(F.col("l_extendedprice"))).alias("sum_cents"), F.count("*").alias("n"))


def nation_revenue(spark, sf_dir):
    """Revenue by nation: four joins, the small sides broadcast by their size."""
    o, c, n, r = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def part_rollup(spark, sf_dir):
    li, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).rollup("p_brand", "p_type").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.countDistinct("l_orderkey").alias("orders"))


def event_windows(spark, sf_dir):
    return streams.windowed(_t(spark, sf_dir, "events"), "ts", "event_type", "value").select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def event_sessions(spark, sf_dir):
    s = streams.sessions(_t(spark, sf_dir, "events"), "ts", "user_id")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def block_reconciliation(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("block"), F.when(F.col("event_id") == 3000, "clear").when(F.col("event_type") == "click", "remove").otherwise("store").alias("event_type"))
    return streams.latest_blocks(e)


def fork_join(spark, sf_dir):
    """Two prompts a row, answered by a stand-in model, gathered in order."""
    b = _t(spark, sf_dir, "benchmark")
    f = models.forked(b, "item_id", [("pro", F.concat(F.lit("For: "), "text")), ("con", F.concat(F.lit("Against: "), "text"))])
    g = models.gathered(models.completed(f, "prompt", models.Echo()), "item_id", "completion")
    return g.select("item_id", F.col("values")[0].alias("pro"), F.col("values")[1].alias("con"))


QUERIES = {f.__name__: f for f in (pricing_summary, nation_revenue, part_rollup, event_windows, event_sessions, block_reconciliation, fork_join)}

ORACLES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum_cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "nation_revenue": "SELECT r_name, n_name, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "part_rollup": "SELECT p_brand, p_type, sum(l_quantity::BIGINT)::BIGINT AS qty, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type)",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """
        WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
        s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""",
    "block_reconciliation": """
        WITH e AS (SELECT event_id AS seq, user_id % 50 AS block, CASE WHEN event_id = 3000 THEN 'clear' WHEN event_type = 'click' THEN 'remove' ELSE 'store' END AS k FROM events)
        SELECT block, max(seq) AS seq FROM e WHERE k <> 'clear' GROUP BY block HAVING arg_max(k, seq) = 'store' AND max(seq) > coalesce((SELECT max(seq) FROM e WHERE k = 'clear'), -1)""",
    "fork_join": "SELECT item_id, md5('For: ' || text) AS pro, md5('Against: ' || text) AS con FROM benchmark",
}
