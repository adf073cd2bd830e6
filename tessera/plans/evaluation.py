"""Queries for evaluation: extraction, accuracies, errors, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import answers, text
from tessera.operators import evals


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _judged(spark, sf_dir):
    """Labelled documents with a rule's prediction of their quality."""
    d = _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return d.withColumn("pred", F.when(F.col("n_chars") > 1000, 1).otherwise(0)).withColumn("ok", F.col("pred") == F.col("quality"))


def last_number_accuracy(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    said = F.concat(F.lit("so 1,0"), F.lpad((F.col("event_id") % 50).cast("string"), 2, "0"), F.lit(" or "), F.when(F.col("event_id") % 11 == 0, "none").otherwise(F.get_json_object("props", "$.k")))
    x = e.select("event_type", answers.last_integer(said).alias("pred"), F.get_json_object("props", "$.k").cast("long").alias("gold"))
    return x.groupBy("event_type").agg(F.round(evals.accuracy(F.col("pred") == F.col("gold")), 6).alias("accuracy"), F.round(evals.accuracy(F.col("pred") == answers.INVALID), 6).alias("invalid"), F.sum("pred").alias("total"))


def stated_choices(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("said", F.concat(F.lit("Well.\nanswer: "), F.substring(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)), F.lit(" I think")))
    return d.select("doc_id", answers.stated_choice(F.col("said")).alias("choice"), answers.stated_line(F.col("said")).alias("line"), answers.first_char(F.col("said")).alias("head"))


def numbers_after_prefix(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    said = F.concat(F.lit("Answer: 7. Answer: about 1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((F.col("o_orderkey") % 4 * 50).cast("string"), 2, "0"), F.lit(" in all"))
    return o.select("o_orderkey", answers.number_after(said, "Answer:").alias("number"))


def mcq_accuracy_rollup(spark, sf_dir):
    r = evals.by_group(_judged(spark, sf_dir), ["lang", "source"], F.col("ok"))
    return r.select("lang", "source", F.round("accuracy", 6).alias("accuracy"), "n")


def macro_micro(spark, sf_dir):
    return evals.macro_micro(_judged(spark, sf_dir), "source", F.col("ok")).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


def weighted_hierarchy(spark, sf_dir):
    """Category accuracies, pooled into domains by their rows, rounded to three places."""
    each = _judged(spark, sf_dir).groupBy("lang", "source").agg(evals.accuracy(F.col("ok")).alias("acc"), F.count("*").alias("n"))
    return each.groupBy("lang").agg(F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 3).alias("acc"), F.sum("n").alias("n"))


def mean_std_by_metric(spark, sf_dir):
    m = _judged(spark, sf_dir).select(F.create_map(F.lit("score"), F.col("ok").cast("double"), F.lit("chars"), F.col("n_chars").cast("double")).alias("m"))
    return evals.metric_table(m, "m").select("name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def standard_error(spark, sf_dir):
    return evals.standard_error(_judged(spark, sf_dir), "source", F.col("ok").cast("double")).select(F.round("accuracy", 6).alias("accuracy"), F.round("standard_error", 6).alias("standard_error"))


def pass_at_k(spark, sf_dir):
    n = _judged(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"))
    return n.select("source", *[F.round(evals.pass_at_k(F.col("n"), F.col("c"), k), 6).alias(f"pass_{k}") for k in (1, 2, 5)])


def majority_vote(spark, sf_dir):
    return evals.majority(_docs(spark, sf_dir), "source", "doc_id", "lang").select("source", "lang", "votes")


def positional_quantiles(spark, sf_dir):
    d = _docs(spark, sf_dir).groupBy("source").agg(F.collect_list("n_chars").alias("v"))
    return d.select("source", evals.positional(F.col("v"), 0.9).alias("p90"), evals.positional(F.col("v"), 0.5).alias("median"))


def lookup_default_category(spark, sf_dir):
    lookup = spark.createDataFrame([("en", "west"), ("de", "west"), ("fr", "south")], "lang string, family string")
    j = _docs(spark, sf_dir).join(F.broadcast(lookup), "lang", "left")
    return j.groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.count("*").alias("n"))


def ordered_hash_join(spark, sf_dir):
    """Rows of one table with those of another by a hash of their text, the last of a hash winning, in the first's order."""
    d = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("h"))
    last = _docs(spark, sf_dir).groupBy(F.md5("text").alias("h")).agg(F.max_by("source", "doc_id").alias("source"))
    return d.join(last, "h").select("doc_id", "source").orderBy("doc_id")


def zipped_predictions(spark, sf_dir):
    """Predictions and labels met by an explicit id, not by position."""
    return _judged(spark, sf_dir).groupBy("quality", "pred").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def word_containment(spark, sf_dir):
    """Documents that hold every word of a label."""
    label = F.when(F.col("lang") == "en", "the and").otherwise(F.concat(F.lit("la "), F.col("lang")))
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count_if(answers.holds_all_words(F.col("text"), label)).alias("n"))


def any_number_match(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.count_if(answers.any_number_is(F.col("props"), (F.col("event_id") % 100).cast("string"))).alias("n"))


def free_choices(spark, sf_dir):
    o = F.array(*[F.lit(x) for x in ("red", "green", "blue", "grey")])
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")
    said = F.element_at(F.array(F.lit("(A) or maybe (C)"), F.lit("it is B."), F.lit("I would say that the blue one is right"), F.lit("no idea")), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select("item_id", answers.chosen_option(said, o).alias("choice"))


def normal_values(spark, sf_dir):
    """Numbers to two places, half to even."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select("s_suppkey", answers.normal_value(F.concat(F.lit("1,"), (F.col("s_suppkey") % 900 + 100).cast("string"), F.lit(".125"))).alias("v"), answers.normal_value(F.lit("Q")).alias("one"))


def choice_logprobs(spark, sf_dir):
    """The choice of best mean log-probability, with and without an unconditional one taken off."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("e"))
    lp = F.array(F.slice("e", 1, 4), F.slice("e", 5, 6), F.slice("e", 11, 5))
    base = F.slice("e", 20, 3)
    return v.select("vec_id", answers.best_choice(lp).alias("best"), answers.best_choice(lp, base).alias("best_conditional"))


def label_scores(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("lp"))
    return v.select("vec_id", F.posexplode(answers.label_shares(F.col("lp"))).alias("label", "share")).select("vec_id", "label", F.round("share", 6).alias("share"))


def code_blocks(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.concat(F.lit("Sure.\n```python\ndef f(x):\n    return "), F.col("item_id").cast("string"), F.lit("\n```\n```output\n"), F.col("item_id").cast("string"), F.lit("\n```")).alias("t"))
    return b.select("item_id", answers.fenced_code(F.col("t")).alias("body"), answers.last_output(F.col("t")).alias("output"))


def reasoning_split(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("<think>"), "text", F.when(F.col("doc_id") % 3 != 0, F.lit("</think>")).otherwise(F.lit("")), "source").alias("t"))
    return d.select("doc_id", text.split_reasoning(F.col("t")).alias("r")).select("doc_id", F.length("r.reasoning").alias("n_reasoning"), F.length("r.answer").alias("n_answer"))


def overlap_merge(spark, sf_dir):
    """Chunks of a text that overlap, put together again."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("n", F.length("text"))
    d = b.select("item_id", F.substring("text", F.lit(1), F.ceil(F.col("n") * 0.6).cast("int")).alias("a"), F.substring("text", F.floor(F.col("n") * 0.4).cast("int") + 1, F.col("n")).alias("b"))
    return d.select("item_id", F.md5(F.concat("a", text.trim_overlap(F.col("a"), F.col("b")))).alias("md5"))


def math_answers(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.concat(F.lit(r"so \boxed{\frac{1}{"), (F.col("item_id") + 2).cast("string"), F.lit("}}.")).alias("t"))
    b = b.withColumn("found", answers.extract_math(F.col("t")))
    return b.select("item_id", "found", answers.equal_math(F.col("found"), F.concat(F.lit("1/"), (F.col("item_id") + 2).cast("string"))).alias("text_equal"), answers.equal_math(F.col("found"), (F.lit(1.0) / (F.col("item_id") + 2)).cast("string")).alias("equal"))


QUERIES = {f.__name__: f for f in (last_number_accuracy, stated_choices, numbers_after_prefix, mcq_accuracy_rollup, macro_micro, weighted_hierarchy, mean_std_by_metric, standard_error, pass_at_k, majority_vote, positional_quantiles, lookup_default_category, ordered_hash_join, zipped_predictions, word_containment, any_number_match, free_choices, normal_values, choice_logprobs, label_scores, code_blocks, reasoning_split, overlap_merge, math_answers)}

_J = "(SELECT *, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pred, (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) = quality AS ok FROM documents JOIN labels USING (doc_id))"
_MEAN = "list_sum({0}) / len({0})"
_BEST = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END"

ORACLES = {
    "last_number_accuracy": """
        WITH x AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 1000 + event_id % 50 ELSE json_extract_string(props, '$.k')::BIGINT END AS pred,
                          json_extract_string(props, '$.k')::BIGINT AS gold FROM events)
        SELECT event_type, round(avg((pred = gold)::INT), 6) AS accuracy, 0.0::DOUBLE AS invalid, sum(pred)::BIGINT AS total FROM x GROUP BY 1""",
    "stated_choices": "SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN substr('ABCD', (doc_id % 5 + 1)::INT, 1) END AS choice, substr('ABCDE', (doc_id % 5 + 1)::INT, 1) || ' I think' AS line, 'W' AS head FROM documents",
    "numbers_after_prefix": "SELECT o_orderkey, '1' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.1' ELSE '.15' END AS number FROM orders",
    "mcq_accuracy_rollup": f"SELECT lang, source, round(avg(ok::INT), 6) AS accuracy, count(*) AS n FROM {_J} GROUP BY ROLLUP (lang, source)",
    "macro_micro": f"SELECT round(avg(r / n), 6) AS macro, round(sum(r) / sum(n), 6) AS micro FROM (SELECT source, sum(ok::INT)::DOUBLE AS r, count(*) AS n FROM {_J} GROUP BY 1)",
    "weighted_hierarchy": f"SELECT lang, round(sum(a * n) / sum(n), 3) AS acc, sum(n)::BIGINT AS n FROM (SELECT lang, source, avg(ok::INT) AS a, count(*) AS n FROM {_J} GROUP BY 1, 2) GROUP BY 1",
    "mean_std_by_metric": f"SELECT 'score' AS name, round(avg(ok::INT), 4) AS mean, round(stddev_pop(ok::INT), 4) AS std FROM {_J} UNION ALL SELECT 'chars', round(avg(n_chars), 4), round(stddev_pop(n_chars), 4) FROM {_J}",
    "standard_error": f"SELECT round(avg(m), 6) AS accuracy, round(avg(se), 6) AS standard_error FROM (SELECT avg(ok::INT) AS m, stddev_samp(ok::INT) / sqrt(count(*)) AS se FROM {_J} GROUP BY source)",
    "pass_at_k": f"""
        WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (ok) AS c FROM {_J} GROUP BY 1)
        SELECT source, {", ".join(f"CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE round(1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - {k} / i)), 6) END AS pass_{k}" for k in (1, 2, 5))} FROM g""",
    "majority_vote": "SELECT source, lang, votes FROM (SELECT source, lang, count(*) AS votes, min(doc_id) AS s FROM documents GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, s) = 1",
    "positional_quantiles": "SELECT source, v[floor(len(v) * 0.9::DOUBLE)::INT + 1] AS p90, v[floor(len(v) * 0.5::DOUBLE)::INT + 1] AS median FROM (SELECT source, list(n_chars ORDER BY n_chars) AS v FROM documents GROUP BY 1)",
    "lookup_default_category": "SELECT CASE WHEN lang IN ('en', 'de') THEN 'west' WHEN lang = 'fr' THEN 'south' ELSE 'other' END AS family, count(*) AS n FROM documents GROUP BY 1",
    "ordered_hash_join": "SELECT d.doc_id, l.source FROM documents d JOIN (SELECT md5(text) AS h, arg_max(source, doc_id) AS source FROM documents GROUP BY 1) l ON md5(d.text) = l.h",
    "zipped_predictions": f"SELECT quality, pred, count(*) AS n, count(*) FILTER (toxic = 1) AS toxic FROM {_J} GROUP BY 1, 2",
    "word_containment": "SELECT lang, count(*) FILTER (CASE WHEN lang = 'en' THEN contains(lower(text), 'the') AND contains(lower(text), 'and') ELSE contains(lower(text), 'la') AND contains(lower(text), lang) END) AS n FROM documents GROUP BY 1",
    "any_number_match": "SELECT event_type, count(*) FILTER (list_contains(regexp_extract_all(props, '\\d+'), (event_id % 100)::VARCHAR)) AS n FROM events GROUP BY 1",
    "free_choices": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS choice FROM benchmark",
    "normal_values": "SELECT s_suppkey, '1' || (s_suppkey % 900 + 100)::VARCHAR || '.12' AS v, ' q ' AS one FROM supplier",
    "choice_logprobs": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS e FROM embeddings), m AS (
            SELECT vec_id, {_MEAN.format("e[1:4]")} AS a, {_MEAN.format("e[5:10]")} AS b, {_MEAN.format("e[11:15]")} AS c, e FROM v)
        SELECT vec_id, {_BEST.format("a", "b", "c")} AS best, {_BEST.format("(a - e[20])", "(b - e[21])", "(c - e[22])")} AS best_conditional FROM m""",
    "label_scores": """
        WITH v AS (SELECT vec_id, list_transform(embedding[:3], lambda x: exp(x::DOUBLE)) AS e FROM embeddings)
        SELECT vec_id, i::INTEGER AS label, round(e[i + 1] / (e[1] + e[2] + e[3]), 6) AS share FROM v, range(3) r(i)""",
    "code_blocks": "SELECT item_id, '    return ' || item_id || chr(10) AS body, item_id::VARCHAR AS output FROM benchmark",
    "overlap_merge": """
        SELECT item_id, md5(a || substr(b, 1 + coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda n: right(a, n) = left(b, n))), 0))) AS md5
        FROM (SELECT item_id, substr(text, 1, ceil(length(text) * 0.6::DOUBLE)::INT) AS a, substr(text, floor(length(text) * 0.4::DOUBLE)::INT + 1) AS b FROM benchmark)""",
}
