"""Queries that write tables by the sinks and read them again by the sources, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.shared import scratch_path
from tessera.sources import io


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _benchmark(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark")


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def text_files(spark, sf_dir):
    """Texts written as JSON lines and read again, with how often each is there."""
    at = scratch_path(spark, "texts")
    io.write_text_lines(_table(spark, sf_dir, "documents").where("text IS NOT NULL"), at)
    return io.json_lines(spark, at, io.CHATML).groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"))


def broken_json_lines(spark, sf_dir):
    """JSON lines of which some are cut off or blank: the rest is read."""
    at, b = scratch_path(spark, "broken"), _benchmark(spark, sf_dir)
    whole = _json(item_id=F.col("item_id"), text=F.col("text"))
    cut = F.when(F.col("item_id") % 3 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).when(F.col("item_id") % 3 == 1, F.concat(whole, F.lit("\n  "))).otherwise(whole)
    b.select(cut.alias("value")).write.option("compression", "gzip").text(at)
    return io.json_lines(spark, at, "item_id long, text string").select("item_id", F.md5("text").alias("md5"))


def json_array_files(spark, sf_dir):
    """JSON arrays of up to fifty items and a number among them, one a file."""
    at, b = scratch_path(spark, "arrays"), _benchmark(spark, sf_dir)
    item = _json(instruction=F.col("text"), output=F.col("item_id").cast("string"))
    arrays = b.groupBy(F.floor(F.col("item_id") / 50)).agg(F.concat(F.lit("[3, "), F.array_join(F.collect_list(item), ", "), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return io.json_array(spark, at, io.TRIPLE).select(F.col("output").cast("long").alias("item_id"), F.md5("instruction").alias("md5"), F.coalesce("input", F.lit("none")).alias("input"))


def commented_lines(spark, sf_dir):
    """JSON lines between comments and blank lines."""
    at, b = scratch_path(spark, "commented"), _benchmark(spark, sf_dir)
    b.select(F.concat(F.lit("# {note\n \n"), _json(text=F.concat(F.lit("# "), "text"))).alias("value")).write.text(at)
    return io.tagged_lines(spark, at, io.CHATML).groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"))


def stripped_lines(spark, sf_dir):
    """Lines of texts and lines of white space, stripped; blank ones go."""
    at = scratch_path(spark, "lines")
    padded = F.concat(F.lit("\t\n 　"), "text", F.lit(" \n \t"))
    _table(spark, sf_dir, "conversations").select(padded.alias("value")).write.text(at)
    return io.lines(spark, at).groupBy(F.md5("line").alias("md5")).agg(F.count("*").alias("n"))


def csv_files(spark, sf_dir):
    """Texts with quotes, commas and line feeds through CSV with a header."""
    at = scratch_path(spark, "csv")
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('say "'), "text", F.lit('",\nthen stop')).alias("said"))
    c.write.option("quote", '"').option("escape", '"').csv(at, header=True)
    return io.csv(spark, at, "conv_id long, turn long, said string").select("conv_id", "turn", F.md5("said").alias("md5"))


def tsv_files(spark, sf_dir):
    """Questions and whole-number targets by tabs."""
    at = scratch_path(spark, "tsv")
    _table(spark, sf_dir, "orders").select(F.concat(F.lit("how many, "), "o_orderpriority", F.lit("?")), F.col("o_orderkey").cast("string")).write.csv(at, sep="\t")
    return io.tsv_pairs(spark, at, "en")


def shared_chat_files(spark, sf_dir):
    """Chats under either of two keys."""
    at, b = scratch_path(spark, "chats"), _benchmark(spark, sf_dir)
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("text").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("item_id").cast("string").alias("value")))
    line = F.when(F.col("item_id") % 2 == 0, _json(conversations=turns)).otherwise(_json(conversation=turns))
    b.select(line.alias("value")).write.text(at)
    t = io.shared_chats(spark, at)
    return t.select(F.element_at("turns", 2)["value"].cast("long").alias("item_id"), F.md5(F.element_at("turns", 1)["value"]).alias("md5"), F.size("turns").alias("turns"))


def alternating_files(spark, sf_dir):
    """Flat lists of one to four turns: the pairs of each, an odd turn at the end left out."""
    at, b = scratch_path(spark, "flat"), _benchmark(spark, sf_dir)
    flat = F.transform(F.sequence(F.lit(0), F.col("item_id") % 4), lambda i: F.concat(F.col("item_id").cast("string"), F.lit("/"), i.cast("string")))
    b.select(_json(data=flat).alias("value")).write.text(at)
    return io.alternating(spark, at).select(F.explode("turns").alias("t")).select("t.user", "t.assistant")


def question_files(spark, sf_dir):
    """Question lists kept as literals, with quotes of both kinds; without one, a summary."""
    at, b = scratch_path(spark, "questions"), _benchmark(spark, sf_dir)
    n = F.col("item_id").cast("string")
    pairs = F.concat(F.lit("[{'Q': \"what's "), n, F.lit("?\", 'A': "), n, F.lit("}, {'Q': 'and \"so\"?', 'A': 'no'}]"))
    kept = F.when(F.col("item_id") % 3 == 0, pairs).when(F.col("item_id") % 3 == 1, F.lit("None"))
    b.select(_json(input=F.concat(n, F.lit(": "), "text"), qa_pairs=kept).alias("value")).write.text(at)
    q = io.question_lists(spark, at)
    return q.select(F.substring_index("input", ":", 1).cast("long").alias("item_id"), "task", F.coalesce("question", F.lit("-")).alias("question"), F.md5("answer").alias("answer_md5"))


def batch_files(spark, sf_dir):
    """Batch requests read, and answered with an error for each fifth: total, completed and failed."""
    at, b = scratch_path(spark, "batch"), _benchmark(spark, sf_dir)
    line = _json(custom_id=F.col("item_id").cast("string"), method=F.lit("POST"), url=F.lit("/v1/completions"), body=_json(prompt=F.col("text"), stream=F.lit(False)))
    b.select(line.alias("value")).write.text(at)
    jobs = io.batch_jobs(spark, at)
    done = jobs.select("custom_id", F.md5(F.get_json_object("body", "$.prompt")).alias("response"), F.when(F.col("custom_id").cast("long") % 5 == 0, "timeout").alias("error"))
    out = scratch_path(spark, "answered")
    counts = io.write_batch(done, out)
    answers = io.json_lines(spark, out, "custom_id string, response string, error string")
    return answers.select("custom_id", "response", F.coalesce("error", F.lit("-")).alias("error"), *[F.lit(counts[k]).cast("long").alias(k) for k in ("total", "completed", "failed")])


def event_stream_lines(spark, sf_dir):
    """Server-sent events with other lines between them, up to their end mark."""
    at, b = scratch_path(spark, "sse"), _benchmark(spark, sf_dir)
    b.select(F.concat(F.lit(": ping\nevent: x\ndata: "), _json(item_id=F.col("item_id"), text=F.col("text")), F.lit("\n\ndata: [DONE]")).alias("value")).write.text(at)
    return io.sse(spark, at, "item_id long, text string").select("item_id", F.md5("text").alias("md5"))


def labelled_subjects(spark, sf_dir):
    """Subjects loaded one by one and set after one another."""
    r = _table(spark, sf_dir, "region")
    names = ("AFRICA", "EUROPE", "ASIA")
    return io.labelled([(n, r.where(F.col("r_name") == n).select("r_regionkey")) for n in names])


def appended_once(spark, sf_dir):
    """Documents appended to a table twice, by their texts' hashes: each is there once, with the least id of the first run."""
    at = scratch_path(spark, "sink")
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.md5("text").alias("fp"), "doc_id")
    for part in (d.where("doc_id % 2 = 0"), d):
        io.append_unseen(part, at, "fp", ("doc_id",))
    return spark.read.schema("fp string, doc_id long").parquet(at)


def conversation_files(spark, sf_dir):
    """Conversations written and counted in one pass, and read again."""
    at = scratch_path(spark, "conversations")
    pairs = F.array(F.struct(F.col("text").alias("human"), F.lit("yes").alias("assistant")))
    n = io.write_conversations(_benchmark(spark, sf_dir).select(F.col("item_id").alias("conversation_id"), F.lit("qa").alias("category"), pairs.alias("conversation")), at)
    c = io.json_lines(spark, at, io.CONVERSATION)
    return c.select("conversation_id", "category", F.md5(F.get("conversation", F.lit(0))["human"]).alias("md5"), F.lit(n).cast("long").alias("written"))


def banner_files(spark, sf_dir):
    """Rows with numbered banners before them: the banners of the file."""
    at = scratch_path(spark, "banners")
    io.write_banners(_benchmark(spark, sf_dir), "text", at, ["item_id"])
    lines = spark.read.text(at).where(F.col("value").rlike(r"^={40} \d+$"))
    return lines.select(F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("number"))


def summary_file(spark, sf_dir):
    """A run's nested summary beside its output."""
    at = scratch_path(spark, "summary")
    n = _table(spark, sf_dir, "documents").agg(F.count("*").alias("scanned"), F.count("text").alias("kept"))
    io.run_summary(n.select(F.struct("scanned", "kept").alias("counts"), F.struct(F.lit(7).alias("seed")).alias("parameters")), at)
    return io.json_lines(spark, at, "counts struct<scanned:long,kept:long>, parameters struct<seed:long>").select("counts.scanned", "counts.kept", "parameters.seed")


_FILES = (text_files, broken_json_lines, json_array_files, commented_lines, stripped_lines, csv_files, tsv_files, shared_chat_files, alternating_files, question_files, batch_files, event_stream_lines)
QUERIES = {f.__name__: f for f in (*_FILES, labelled_subjects, appended_once, conversation_files, banner_files, summary_file)}

_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ORACLES = {
    "text_files": "SELECT md5(text) AS md5, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "broken_json_lines": "SELECT item_id, md5(text) AS md5 FROM benchmark WHERE item_id % 3 <> 0",
    "json_array_files": "SELECT item_id, md5(text) AS md5, 'none' AS input FROM benchmark",
    "commented_lines": "SELECT md5('# ' || text) AS md5, count(*) AS n FROM benchmark GROUP BY 1",
    "stripped_lines": rf"""
        WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM conversations),
        s AS (SELECT regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line FROM l)
        SELECT md5(line) AS md5, count(*) AS n FROM s WHERE line <> '' GROUP BY 1""",
    "csv_files": "SELECT conv_id, turn, md5('say \"' || text || '\",' || chr(10) || 'then stop') AS md5 FROM conversations",
    "tsv_files": "SELECT 'how many, ' || o_orderpriority || '?' AS inputs, o_orderkey::VARCHAR AS targets, 'en' AS lang FROM orders",
    "shared_chat_files": "SELECT item_id, md5(text) AS md5, 2 AS turns FROM benchmark",
    "alternating_files": """
        SELECT item_id::VARCHAR || '/' || (2 * k)::VARCHAR AS user, item_id::VARCHAR || '/' || (2 * k + 1)::VARCHAR AS assistant
        FROM benchmark, range(2) r(k) WHERE 2 * k + 1 <= item_id % 4""",
    "question_files": """
        SELECT item_id, 'question' AS task, 'what''s ' || item_id::VARCHAR || '?' AS question, md5(item_id::VARCHAR) AS answer_md5 FROM benchmark WHERE item_id % 3 = 0
        UNION ALL SELECT item_id, 'question', 'and "so"?', md5('no') FROM benchmark WHERE item_id % 3 = 0
        UNION ALL SELECT item_id, 'summary', '-', md5(substr(item_id::VARCHAR || ': ' || text, 1, 1024)) FROM benchmark WHERE item_id % 3 <> 0""",
    "batch_files": """
        SELECT item_id::VARCHAR AS custom_id, md5(text) AS response, CASE WHEN item_id % 5 = 0 THEN 'timeout' ELSE '-' END AS error,
               count(*) OVER () AS total, count(*) FILTER (item_id % 5 <> 0) OVER () AS completed, count(*) FILTER (item_id % 5 = 0) OVER () AS failed FROM benchmark""",
    "event_stream_lines": "SELECT item_id, md5(text) AS md5 FROM benchmark",
    "labelled_subjects": """
        SELECT r_regionkey, r_name AS subject, CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'EUROPE' THEN 1 ELSE 2 END AS subject_rank
        FROM region WHERE r_name IN ('AFRICA', 'EUROPE', 'ASIA')""",
    "appended_once": "SELECT md5(text) AS fp, coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "conversation_files": "SELECT item_id AS conversation_id, 'qa' AS category, md5(text) AS md5, count(*) OVER () AS written FROM benchmark",
    "banner_files": "SELECT row_number() OVER (ORDER BY item_id) AS number FROM benchmark",
    "summary_file": "SELECT count(*) AS scanned, count(text) AS kept, 7::BIGINT AS seed FROM documents",
}
