"""Queries over results of runs and requests: response caches, answer files, keyed rows, topic prompts, large images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import programs
from tessera.operators import prompts, quality, ranking
from tessera.operators.shared import scratch_path
from tessera.sources import io


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def response_cache(spark, sf_dir):
    """Two runs over the benchmark by way of a cache, the second for what the first left; errors are left out at the end."""
    at = scratch_path(spark, "responses")
    wanted = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), "text")
    for run, part in ((1, wanted.where("idx % 3 <> 0")), (2, wanted)):
        todo = part if run == 1 else io.uncached(part, at)
        failed = F.when(F.col("idx") % 5 == 0, "timeout")
        io.cache_responses(todo.select("idx", F.concat(F.lit(f"{run}:"), F.md5("text")).alias("response"), failed.alias("error")), at)
    return io.cached_responses(wanted.select("idx"), at)


def result_files(spark, sf_dir):
    """Results of each priority appended without their arrays, and then with them."""
    at = scratch_path(spark, "results")
    o = _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.collect_list("o_orderkey").alias("keys"))
    io.append_results(o, at, details=False)
    io.append_results(o, at)
    r = spark.read.schema("o_orderpriority string, n long, keys array<long>").json(at)
    return r.select("o_orderpriority", "n", F.coalesce(F.size("keys"), F.lit(-1)).cast("long").alias("n_keys"), F.coalesce(F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + k), F.lit(-1).cast("long")).alias("sum_keys"))


def keyed_rows(spark, sf_dir):
    """Page texts by the last part of their path, one entry a line."""
    at = scratch_path(spark, "keyed")
    b = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("a/b\"c/"), "item_id", F.lit(".png")).alias("path"), "text")
    io.write_keyed(b, "path", "text", at)
    return io.keyed(spark, at).select("key", F.md5("value").alias("md5"))


def answer_rows(spark, sf_dir):
    """Answers of two turns with ids and times: how many there are of each question, and whether ids and times are in order."""
    at = scratch_path(spark, "answers")
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array("text", F.upper("text")).alias("turns"))
    io.write_answers(b, "stub", at)
    a = io.json_lines(spark, at, "question_id long, answer_id string, model_id string, choices struct<index:long,turns:array<string>>, tstamp double")
    sound = F.col("answer_id").rlike("^[0-9a-f]{32}$") & (F.col("tstamp") > 1e9)
    return a.select("question_id", "model_id", F.col("choices.index").alias("index"), F.md5(F.get("choices.turns", F.lit(0))).alias("md5"), F.size("choices.turns").alias("n"), sound.alias("sound"))


def topic_prompts(spark, sf_dir):
    """Messages that ask for a number of samples on each nation."""
    m = prompts.topic_messages("You label data.", "Write {n} samples on {topic}; all on {topic}.", topic=F.col("n_name"), n=F.col("n_regionkey"))
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(m).alias("m"))
    return n.select("n_nationkey", "m.role", "m.content")


def large_images(spark, sf_dir):
    """Of images as large as line items say, how many are skipped, by return flag; rows without a size would go first."""
    rows = quality.present(_table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 40).cast("long").alias("w"), (F.col("l_linenumber") * 300).cast("long").alias("h")), "w", "h")
    return rows.groupBy("l_returnflag").agg(*quality.large_share(F.col("w"), F.col("h"), 1_000_000), F.count_if(~quality.is_large(F.col("w"), F.col("h"), 1_000_000)).alias("kept"))


def subtree_schedule(spark, sf_dir):
    """Documents as requests at nodes of a tree of sources and languages, a seventh of them at a source itself, depth first by the rows below."""
    lang = F.when(F.col("doc_id") % 7 > 0, F.array(F.coalesce("lang", F.lit("")))).otherwise(F.array().cast("array<string>"))
    d = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.concat(F.array(F.coalesce("source", F.lit(""))), lang).alias("path"))
    return ranking.subtree_order(d, "doc_id", "path", "place")


@programs.function()
def _quiz(s, text, task):
    return s.system(task).user(text).gen("reason").say("\nHow many? ").gen_int("n").say("\nSo: ").select("choice", ["yes", "no", "unknown"])


def prompt_program(spark, sf_dir):
    """A program over the benchmark: a completion, a number and a choice, each after what was said before."""
    done = _quiz.bind(task="Judge.").run_batch(_table(spark, sf_dir, "benchmark").where("text IS NOT NULL"), "text")
    return done.select("item_id", "reason", F.coalesce("n", F.lit(-1)).alias("n"), "choice", F.md5("said").alias("md5"))


def _banned(scores, params):
    scores[params["ban"] % len(scores)] = -1e9
    return scores


def score_processor(spark, sf_dir):
    """Vectors as scores, of which each row bans one by its own parameters: the place of the best that is left."""
    v = _table(spark, sf_dir, "embeddings").where("size(embedding) > 0")
    left = programs.processed(F.col("embedding"), F.to_json(F.struct((F.col("vec_id") * 7).alias("ban"))), _banned)
    return v.select("vec_id", left.alias("s")).select("vec_id", (F.array_position("s", F.array_max("s")) - 1).alias("best"))


QUERIES = {f.__name__: f for f in (response_cache, result_files, keyed_rows, answer_rows, topic_prompts, large_images, subtree_schedule, prompt_program, score_processor)}

ORACLES = {
    "response_cache": "SELECT item_id AS idx, CASE WHEN item_id % 3 <> 0 THEN '1:' ELSE '2:' END || md5(text) AS response FROM benchmark WHERE item_id % 5 <> 0",
    "result_files": """
        SELECT o_orderpriority, count(*) AS n, unnest([-1, count(*)]) AS n_keys, unnest([-1, sum(o_orderkey)::BIGINT]) AS sum_keys FROM orders GROUP BY 1""",
    "keyed_rows": "SELECT item_id::VARCHAR || '.png' AS key, md5(text) AS md5 FROM benchmark",
    "answer_rows": "SELECT item_id AS question_id, 'stub' AS model_id, 0::BIGINT AS index, md5(text) AS md5, 2::INT AS n, true AS sound FROM benchmark",
    "topic_prompts": """
        SELECT n_nationkey, 'system' AS role, 'You label data.' AS content FROM nation
        UNION ALL SELECT n_nationkey, 'user', 'Write ' || n_regionkey::VARCHAR || ' samples on ' || n_name || '; all on ' || n_name || '.' FROM nation""",
    "large_images": """
        WITH i AS (SELECT l_returnflag, (l_quantity * 40)::BIGINT * (l_linenumber * 300)::BIGINT >= 1000000 AS large FROM lineitem WHERE l_quantity IS NOT NULL AND l_linenumber IS NOT NULL)
        SELECT l_returnflag, count(*) FILTER (large) AS skipped, round(100.0::DOUBLE * count(*) FILTER (large) / count(*), 2) AS percent, count(*) FILTER (NOT large) AS kept FROM i GROUP BY 1""",
    "subtree_schedule": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS s, CASE WHEN doc_id % 7 > 0 THEN coalesce(lang, '') END AS l FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT *, count(*) OVER (PARTITION BY s) AS ws, count(*) OVER (PARTITION BY s, l) AS wl FROM d)
        SELECT doc_id, row_number() OVER (ORDER BY ws DESC, s, l IS NULL, wl DESC, l, doc_id) - 1 AS place FROM w""",
    "prompt_program": """
        WITH a AS (SELECT item_id, '<|system|>' || chr(10) || 'Judge.' || chr(10) || '<|user|>' || chr(10) || text || chr(10) AS p FROM benchmark WHERE text IS NOT NULL),
        b AS (SELECT item_id, md5(p) AS reason, p || md5(p) || chr(10) || 'How many? ' AS p FROM a),
        c AS (SELECT *, TRY_CAST(regexp_extract(md5(p), '[0-9]{1,18}') AS BIGINT) AS n FROM b),
        d AS (SELECT item_id, reason, n, p || coalesce(n::VARCHAR, '') || chr(10) || 'So: ' AS p FROM c),
        o AS (SELECT d.*, choice, place, md5(p || choice) AS h FROM d, (VALUES ('yes', 0), ('no', 1), ('unknown', 2)) o(choice, place)),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY strpos('0123456789abcdef', h[1]) + strpos('0123456789abcdef', h[2]), place) AS r FROM o)
        SELECT item_id, reason, coalesce(n, -1) AS n, choice, md5(p || choice) AS md5 FROM r WHERE r = 1""",
    "score_processor": """
        WITH s AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i - 1 = (vec_id * 7) % len(embedding) THEN -1e9::DOUBLE ELSE x::DOUBLE END) AS s FROM embeddings WHERE len(embedding) > 0)
        SELECT vec_id, list_position(s, list_max(s)) - 1 AS best FROM s""",
}
