"""Queries over answers of many forms and over text edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import answers, text
from tessera.operators import quality


def _benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("n", F.col("item_id").cast("string"))


def _one_of(*forms):
    """The form that an item's number picks."""
    return F.element_at(F.array(*forms), (F.col("item_id") % len(forms) + 1).cast("int"))


def phrase_answers(spark, sf_dir):
    """What follows the first phrase of a list that occurs, whatever else does."""
    said = _one_of(F.concat(F.lit("final answer is 0\nThe best answer is: **"), "n", F.lit("**.")), F.concat("text", F.lit(" the final answer is "), "n", F.lit(" *.")), F.lit("no answer"))
    found = answers.by_phrases(said, ("best answer is", "final answer is"))
    return _benchmark(spark, sf_dir).select("item_id", F.coalesce(found, F.lit("-")).alias("found"))


def listed_answers(spark, sf_dir):
    """Several answers, split where the question or the notation says so."""
    b = _benchmark(spark, sf_dir)
    question = F.when(F.col("item_id") % 2 == 0, "Give all, separated by commas.").otherwise("Give all.")
    said = _one_of(F.concat("n", F.lit(", b")), F.concat("n", F.lit(", b")), F.concat(F.lit("("), "n", F.lit(", 2)")), F.concat("n", F.lit(r" \text{and} 3")))
    return b.select("item_id", F.array_join(answers.several_answers(said, question), "|").alias("found"))


def number_lists(spark, sf_dir):
    """Numbers with commas, in scientific notation, and plain ones, each kind in order."""
    b = _benchmark(spark, sf_dir)
    said = F.concat(F.lit("about 1,"), F.lpad(F.col("n"), 3, "0"), F.lit(" of "), "n", F.lit(".5 or 3e-"), (F.col("item_id") % 9).cast("string"), F.lit(" and -"), "n")
    return b.where("item_id < 1000").select("item_id", F.array_join(answers.numbers_in(said), "|").alias("found"))


def open_answers(spark, sf_dir):
    """Free answers of several forms: the texts and numbers that they may mean, and whether one is right."""
    b = _benchmark(spark, sf_dir)
    said = _one_of(
        F.concat(F.lit(" First x = 7\nSo the Result is X = "), "n", F.lit(". ")),
        F.concat(F.lit("The final answer is :\nThus it could be Pear "), "n"),
        F.lit("...Nothing Known..."),
        F.lit("the answer is B."),
    )
    golds = F.array(F.col("n"), F.lit("B"), F.lit("nothing"))
    found = b.select("item_id", "n", answers.open_answers(said).alias("f"))
    return found.select("item_id", F.array_join("f.strs", "|").alias("strs"), F.array_join(F.transform("f.nums", lambda x: x.cast("long").cast("string")), "|").alias("nums"), answers.open_correct(F.col("f"), golds).alias("correct"))


def gold_in_text(spark, sf_dir):
    """Whether a page holds any of the right answers."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", answers.any_of(F.col("html"), F.array(F.substring("url", 8, 5), F.lit("<table"), F.lit("%no%"))).alias("right"))


def text_edges(spark, sf_dir):
    """Prefixes and suffixes removed, texts cut at a stop, and characters of a script."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    t = F.col("text")
    return d.select(
        "doc_id", F.md5(text.remove_prefix(t, "The ")).alias("no_prefix"), F.md5(text.remove_suffix(t, ".")).alias("no_suffix"), F.md5(text.cut_at(t, ". ")).alias("cut"),
        text.is_script_char(F.substring(t, 1, 1), "latin").alias("latin"), text.script_ratio_ok(t, "latin", 0.8).alias("mostly_latin"),
    )


def generated_items(spark, sf_dir):
    """Generated triplets that keep the rules on script, length and phrases."""
    b = _benchmark(spark, sf_dir)
    ins = F.repeat(F.lit("汉"), (F.col("item_id") % 300).cast("int"))
    inp = F.concat(F.repeat(F.lit("字"), 40), F.repeat(F.lit("a"), (F.col("item_id") % 60).cast("int")))
    out = F.concat(F.repeat(F.lit("文"), 200), F.when(F.col("item_id") % 7 == 0, "仅供参考").otherwise(""))
    return b.select("item_id", quality.generated_ok(ins, inp, out).alias("ok"))


QUERIES = {f.__name__: f for f in (phrase_answers, listed_answers, number_lists, open_answers, gold_in_text, text_edges, generated_items)}

ORACLES = {
    "phrase_answers": "SELECT item_id, CASE item_id % 3 WHEN 2 THEN '-' ELSE item_id::VARCHAR END AS found FROM benchmark",
    "listed_answers": r"""
        SELECT item_id, CASE item_id % 4 WHEN 0 THEN item_id::VARCHAR || '|b' WHEN 1 THEN item_id::VARCHAR || ', b'
               WHEN 2 THEN '(' || item_id::VARCHAR || ', 2)' ELSE item_id::VARCHAR || '|3' END AS found FROM benchmark""",
    "number_lists": """
        SELECT item_id, array_to_string(['1,' || lpad(item_id::VARCHAR, 3, '0'), '3e-' || (item_id % 9)::VARCHAR, lpad(item_id::VARCHAR, 3, '0'),
               item_id::VARCHAR || '.5', '-' || (item_id % 9)::VARCHAR, '-' || item_id::VARCHAR], '|') AS found FROM benchmark WHERE item_id < 1000""",
    "open_answers": """
        SELECT item_id, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'pear ' || item_id::VARCHAR WHEN 2 THEN 'nothing known' ELSE ' b|b ' END AS strs,
               CASE WHEN item_id % 4 < 2 THEN item_id::VARCHAR ELSE '' END AS nums, true AS correct FROM benchmark""",
    "gold_in_text": "SELECT page_id, contains(html, substr(url, 8, 5)) OR contains(html, '<table') OR contains(html, '%no%') AS right FROM pages",
    "text_edges": """
        SELECT doc_id, md5(CASE WHEN starts_with(text, 'The ') THEN substr(text, 5) ELSE text END) AS no_prefix,
               md5(CASE WHEN ends_with(text, '.') THEN substr(text, 1, length(text) - 1) ELSE text END) AS no_suffix, md5(string_split(text, '. ')[1]) AS cut,
               regexp_full_match(substr(text, 1, 1), '[A-Za-zÀ-ɏ]') AS latin,
               length(text) > 0 AND length(regexp_replace(text, '[^A-Za-zÀ-ɏ]+', '', 'g')) / greatest(1, length(text)) >= 0.8 AS mostly_latin
        FROM documents WHERE text IS NOT NULL""",
    "generated_items": """
        WITH x AS (SELECT item_id, item_id % 300 AS a, item_id % 60 AS l FROM benchmark)
        SELECT item_id, a BETWEEN 20 AND 200 AND 40 / (40 + l) >= 0.6 AND item_id % 7 <> 0 AS ok FROM x""",
}
