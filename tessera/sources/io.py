"""Readers and writers: JSON lines and arrays, chat files, CSV and TSV, result files. Schemas are always given."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.operators import dedup
from tessera.operators.sequence import numbered

TRIPLE = "instruction string, input string, output string"
CHATML = "text string"
CONVERSATION = "conversation_id long, category string, conversation array<struct<human:string,assistant:string>>, system string"
SHARE = "struct<from:string,value:string>"
BATCH_IN = "custom_id string, method string, url string, body string"
RESPONSE = "idx long, response string, error string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped or not. Blank lines and lines that don't parse are skipped."""
    bad = "_corrupt_record"
    df = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return df.where(F.col(bad).isNull()).drop(bad)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array of objects a file, or JSON lines if the name says so. Elements that aren't objects are skipped. A file is one task, as its array can't be cut."""
    if path.endswith((".jsonl", ".jsonl.gz")):
        return json_lines(spark, path, schema)
    whole = spark.read.text(path, wholetext=True)
    first = F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1)
    checked = whole.select(F.when(first == "[", F.col("value")).otherwise(F.raise_error(F.lit("the file isn't a JSON array"))).alias("value"))
    items = checked.select(F.explode(F.from_json("value", "array<string>")).alias("item")).where(F.ltrim("item").startswith("{"))
    return items.select(F.from_json("item", schema).alias("r")).select("r.*")


def tagged_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with # comments; a line that doesn't parse is an error."""
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return t.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines stripped of white space of any kind that aren't blank."""
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("line")).where("line <> ''")


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path, header=header)


def tsv_pairs(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(inputs, targets, lang); a target with a decimal point is an error."""
    t = csv(spark, path, "inputs string, targets string", header=False, sep="\t")
    checked = F.when(F.col("targets").contains("."), F.raise_error(F.concat(F.lit("decimal in "), "targets"))).otherwise(F.col("targets"))
    return t.select("inputs", checked.alias("targets"), F.lit(lang).alias("lang"))


def all_under(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of every *.jsonl below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)


def shared_chats(spark: SparkSession, path: str) -> DataFrame:
    """Chats under either of the two keys in use."""
    df = json_lines(spark, path, f"conversations array<{SHARE}>, conversation array<{SHARE}>")
    return df.select(F.coalesce("conversations", "conversation").alias("turns"))


def alternating(spark: SparkSession, path: str) -> DataFrame:
    """Flat lists of turns, user first: pairs of (user, assistant); an odd one at the end is left out."""
    d = json_lines(spark, path, "data array<string>").where(F.size("data") > 1)
    # guarded here too, since the filter may run after this
    at = F.when(F.size("data") > 1, F.sequence(F.lit(0), F.size("data") - 2, F.lit(2)))
    return d.select(F.transform(at, lambda i: F.struct(F.get("data", i).alias("user"), F.get("data", i + 1).alias("assistant"))).alias("turns"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("Q", T.StringType()), T.StructField("A", T.StringType())])))
def _literal_pairs(s: pd.Series) -> pd.Series:
    def read(text):
        try:
            found = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        if not isinstance(found, list):
            return None
        part = lambda x, k: None if x.get(k) is None else str(x[k])
        return [{"Q": part(x, "Q"), "A": part(x, "A")} for x in found if isinstance(x, dict)]

    return s.map(read, na_action="ignore")


def question_lists(spark: SparkSession, path: str) -> DataFrame:
    """(task, input, question, answer): question lists kept as Python literals; without one, or if it doesn't parse, a summary whose answer is the input's first 1,024 characters."""
    d = json_lines(spark, path, "input string, qa_pairs string")
    pairs = _literal_pairs(F.col("qa_pairs"))
    d = d.withColumn("pairs", F.when(~F.lower(F.coalesce("qa_pairs", F.lit("none"))).isin("none", ""), pairs))
    summary = F.array(F.struct(F.lit(None).cast("string").alias("Q"), F.substring("input", 1, 1024).alias("A")))
    d = d.withColumn("task", F.when(F.size("pairs") > 0, "question").otherwise("summary"))
    return d.select("task", "input", F.explode(F.when(F.col("task") == "question", F.col("pairs")).otherwise(summary)).alias("p")).select("task", "input", F.col("p.Q").alias("question"), F.col("p.A").alias("answer"))


def batch_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Batch requests; a streaming one is an error."""
    d = json_lines(spark, path, BATCH_IN)
    streaming = F.get_json_object("body", "$.stream") == "true"
    return d.withColumn("body", F.when(streaming, F.raise_error(F.lit("streaming isn't supported in a batch"))).otherwise(F.col("body")))


def sse(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Server-sent events: data lines up to [DONE], parsed."""
    t = spark.read.text(path).where(F.col("value").startswith("data: ")).select(F.trim(F.substring("value", 7, 1 << 30)).alias("v"))
    return t.where("v <> '[DONE]'").select(F.from_json("v", schema).alias("r")).select("r.*")


def labelled(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Frames of one schema after one another, with their name and rank."""
    out = None
    for rank, (name, df) in enumerate(frames):
        df = df.withColumn("subject", F.lit(name)).withColumn("subject_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    return out


def write_text_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("text").write.mode(mode).json(path)


def write_conversations(df: DataFrame, path: str) -> int:
    """Writes and counts in one pass; no conversation at all is an error."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    if not seen.get["n"]:
        raise ValueError("nothing was converted")
    return seen.get["n"]


def append_unseen(df: DataFrame, path: str, key: str, order: tuple[str, ...] = ()) -> None:
    """Appends rows whose key the sink doesn't hold yet, of each the first in order (by default, of its columns as JSON); running it again adds nothing."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti")
    first = dedup.first_wins(df, F.col(key), *(order or (F.to_json(F.struct(*df.columns)),)))
    first.write.mode("append").parquet(path)


def write_banners(df: DataFrame, text: str, path: str, order: list[str] | None = None) -> None:
    """A text file with a banner before each row that gives its number, from 1, in order (by default, of the text)."""
    rows = numbered(df, order or [text], "_number", start=1)
    rows = rows.select(F.format_string("%s %d\n%s", F.lit("=" * 40), F.col("_number"), F.coalesce(F.col(text), F.lit(""))).alias("value"), "_number")
    rows.repartitionByRange("_number").sortWithinPartitions("_number").select("value").write.mode("overwrite").text(path)


def write_batch(df: DataFrame, path: str) -> dict[str, int]:
    """Batch results with counts of total, completed and failed."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed")).write.mode("overwrite").json(path)
    return dict(seen.get)


def run_summary(df: DataFrame, path: str) -> None:
    """A run's one row of nested counts and parameters."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report(df: DataFrame, title: str, most: int | None = None) -> str:
    """HTML of the rows of results, all of them unless `most` is given, and then how many more there are. For results of a size that the driver can hold."""
    import html

    rows = [r for r in (df.limit(most + 1) if most is not None else df).toLocalIterator()]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
    more = f"<p>{df.count() - most} more rows</p>" if most is not None and len(rows) > most else ""
    return f"<h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>{more}"


def cache_responses(df: DataFrame, path: str) -> None:
    """Appends (idx, response, error) to a response cache; an index that it holds already, with an error or without, stays as it is."""
    append_unseen(df.select("idx", "response", "error"), path, "idx", ("error", "response"))


def uncached(wanted: DataFrame, path: str) -> DataFrame:
    """The rows whose idx a response cache doesn't hold."""
    return wanted.join(wanted.sparkSession.read.schema(RESPONSE).parquet(path).select("idx"), "idx", "left_anti")


def cached_responses(wanted: DataFrame, path: str) -> DataFrame:
    """The rows with their response; those with an error go, and an index that the cache doesn't hold is an error."""
    cache = wanted.sparkSession.read.schema(RESPONSE).parquet(path).withColumn("_held", F.lit(True))
    missing = F.raise_error(F.format_string("no response for %s", F.col("idx"))).cast("boolean")
    return wanted.join(cache, "idx", "left").where(F.when(F.col("_held"), F.col("error").isNull()).otherwise(missing)).drop("_held", "error")


def append_results(df: DataFrame, path: str, details: bool = True) -> None:
    """Appends result rows as JSON lines, without their arrays unless details are wanted."""
    kept = [f.name for f in df.schema.fields if details or not isinstance(f.dataType, T.ArrayType)]
    df.select(*kept).write.mode("append").json(path)


def write_keyed(df: DataFrame, key: str, value: str, path: str) -> None:
    """JSON lines of one entry each: the key's last part between slashes, and the value."""
    name = F.substring_index(F.col(key).cast("string"), "/", -1)
    df.select(F.to_json(F.create_map(name, F.col(value))).alias("value")).write.mode("overwrite").text(path)


def keyed(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of JSON lines of entries."""
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string, {value}>")))


def write_answers(df: DataFrame, model_id: str, path: str) -> None:
    """(question_id, turns) as JSON lines of answers, each with an id of its own and the time of writing."""
    choices = F.struct(F.lit(0).alias("index"), "turns").alias("choices")
    stamp = F.unix_micros(F.current_timestamp()) / 1e6
    df.select("question_id", F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("answer_id"), F.lit(model_id).alias("model_id"), choices, stamp.alias("tstamp")).write.mode("overwrite").json(path)
