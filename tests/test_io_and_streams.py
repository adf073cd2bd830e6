import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import io
from tessera.streaming import streams


def test_json_lines_skip_what_does_not_parse(spark, tmp_path):
    p = str(tmp_path / "a.jsonl.gz")
    with gzip.open(p, "wt") as f:
        f.write('{"text":"a"}\n\n{broken\n{"text":"b"}\n')
    assert [r.text for r in io.json_lines(spark, p, io.CHATML).collect()] == ["a", "b"]


def test_json_array(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"instruction": "i", "output": "o"}, 3, "x"]))
    assert [tuple(r) for r in io.json_array(spark, str(p), io.TRIPLE).collect()] == [("i", None, "o")]
    q = tmp_path / "b.json"
    q.write_text('{"no": "array"}')
    with pytest.raises(Exception, match="JSON array"):
        io.json_array(spark, str(q), io.TRIPLE).collect()


def test_comments_tsv_and_alternating(spark, tmp_path):
    (tmp_path / "c.txt").write_text('# note\n{"text":"a"}\n')
    assert io.tagged_lines(spark, str(tmp_path / "c.txt"), io.CHATML).count() == 1
    (tmp_path / "t.tsv").write_text("q\t4\n")
    assert tuple(io.tsv_pairs(spark, str(tmp_path / "t.tsv"), "en").first()) == ("q", "4", "en")
    (tmp_path / "u.jsonl").write_text('{"data":["a","b","c"]}\n')
    assert [(t.user, t.assistant) for t in io.alternating(spark, str(tmp_path / "u.jsonl")).first().turns] == [("a", "b")]
    (tmp_path / "s.txt").write_text('data: {"text":"x"}\n\ndata: [DONE]\n')
    assert [r.text for r in io.sse(spark, str(tmp_path / "s.txt"), io.CHATML).collect()] == ["x"]


def test_appending_twice_adds_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "fp long, text string")
    for _ in range(2):
        io.append_unseen(d, str(tmp_path / "out"), "fp")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_question_lists_are_literals(spark, tmp_path):
    rows = [{"input": "abc", "qa_pairs": str([{"Q": "what's \"it\"?", "A": "x"}, {"Q": "two", "A": 2}])}, {"input": "d" * 2000, "qa_pairs": "none"}, {"input": "e", "qa_pairs": "[broken"}, {"input": "f"}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = [tuple(r) for r in io.question_lists(spark, str(tmp_path / "q.jsonl")).collect()]
    assert got == [("question", "abc", "what's \"it\"?", "x"), ("question", "abc", "two", "2"), ("summary", "d" * 2000, None, "d" * 1024), ("summary", "e", None, "e"), ("summary", "f", None, "f")]


def test_lines_of_white_space_are_blank(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\t\n\t\n\u3000\n \x1c\n\n  b c \n")
    assert [r.line for r in io.lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b c"]


def test_banners_are_numbered(spark, tmp_path):
    d = spark.createDataFrame([(k, f"text {k}") for k in (3, 1, 2)], "id long, t string")
    io.write_banners(d, "t", str(tmp_path / "b"), ["id"])
    assert [r.value for r in spark.read.text(str(tmp_path / "b")).collect()] == [x for k in (1, 2, 3) for x in ("=" * 40 + f" {k}", f"text {k}")]


def test_the_first_in_order_is_appended(spark, tmp_path):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "fp long, text string")
    io.append_unseen(d, str(tmp_path / "o"), "fp")
    io.append_unseen(d.withColumn("fp", F.lit(2).cast("long")), str(tmp_path / "o"), "fp", ("text",))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(1, "a"), (2, "a")]


def test_report_has_all_rows_or_says_how_many_more(spark):
    d = spark.range(1200).toDF("id")
    assert io.report(d, "t").count("<tr>") == 1201
    assert "1190 more rows" in io.report(d, "t", 10) and io.report(d, "t", 10).count("<tr>") == 11


def test_counted_writes(spark, tmp_path):
    d = spark.createDataFrame([("1", None), ("2", "e")], "custom_id string, error string")
    assert io.write_batch(d, str(tmp_path / "b")) == {"total": 2, "completed": 1, "failed": 1}
    with pytest.raises(ValueError):
        io.write_conversations(d.where("1 = 0"), str(tmp_path / "c"))


def test_resumable_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "fp long, text string").write.parquet(src)
    for k in range(2):
        s = spark.readStream.schema("fp long, text string").parquet(src)
        streams.resumable(s, out, "fp", str(tmp_path / f"ck{k}")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_tag_parser_over_any_cut():
    whole = "<think>some thought</think>the answer"
    for size in range(1, 12):
        p, r, a = streams.TagParser(), "", ""
        for i in range(0, len(whole), size):
            x, y = p.feed(whole[i : i + size])
            r, a = r + x, a + y
        assert (r, a) == ("some thought", "the answer"), size


def test_tag_parser_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, 1, "<thi"), (1, 2, "nk>r</th"), (1, 3, "ink>a"), (2, 1, "x")]
    spark.createDataFrame(rows, "stream_id long, seq long, chunk string").coalesce(1).write.parquet(src)
    q = streams.parse_tags(spark.readStream.schema("stream_id long, seq long, chunk string").parquet(src)).writeStream.format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.stream_id, r.reasoning, r.answer) for r in spark.table("tags").collect()} == {(1, "r", "a"), (2, "x", "")}


def test_windows_in_a_stream_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.write.parquet(src)
    s = spark.readStream.schema(e.schema).parquet(src)
    streams.windowed(s, "ts", "event_type", "value").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    batch = streams.windowed(e, "ts", "event_type", "value")
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, batch.collect()))


def test_response_cache(spark, tmp_path):
    at = f"{tmp_path}/cache"
    first = spark.createDataFrame([(1, "a", None), (2, None, "timeout")], io.RESPONSE)
    io.cache_responses(first, at)
    io.cache_responses(spark.createDataFrame([(1, "b", None), (2, "c", None), (3, "d", None), (3, "d", None)], io.RESPONSE), at)
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "idx long")
    assert sorted(tuple(r) for r in io.cached_responses(wanted, at).collect()) == [(1, "a"), (3, "d")]
    more = spark.createDataFrame([(3,), (4,)], "idx long")
    assert [r.idx for r in io.uncached(more, at).collect()] == [4]
    with pytest.raises(Exception, match="no response for 4"):
        io.cached_responses(more, at).count()


def test_topic_messages_keep_values_as_they_are(spark):
    from tessera.operators import prompts

    m = spark.range(1).select(prompts.topic_messages("s", "{a} and {b}{a}", a=F.lit("{b}"), b=F.lit(2)).alias("m")).first().m
    assert [tuple(x) for x in m] == [("system", "s"), ("user", "{b} and 2{b}")]
