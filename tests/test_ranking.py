"""Orders and numbers against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import programs
from tessera.operators import ranking, sequence


def depth_first(rows):
    out = []

    def visit(at):
        below = {}
        for id, path in rows:
            if path[: len(at)] == at and len(path) > len(at):
                below.setdefault(path[len(at)], []).append(id)
        for label in sorted(below, key=lambda x: (-len(below[x]), x)):
            visit([*at, label])
        out.extend(sorted(id for id, path in rows if path == at))

    visit([])
    return out


def test_subtree_order(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randrange(5))]) for i in range(150)]
    df = spark.createDataFrame([*rows, (150, None)], "id long, path array<string>")
    got = [r.id for r in ranking.subtree_order(df, "id", "path", "place").orderBy("place").collect()]
    assert got == depth_first([*rows, (150, [])])
    assert ranking.subtree_order(df.where("id < 0"), "id", "path", "place").count() == 0


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = sequence.numbered(df, ["k", "id"], "n", start=1).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [r.id for r in got] == sorted(range(1000), key=lambda i: (i % 7, i))
    assert sequence.numbered(df.where("id < 0"), ["k", "id"], "n").count() == 0


def test_program_of_a_model_that_fails(spark):
    class Broken:
        def complete(self, prompt):
            raise ValueError("no")

    @programs.function(model=Broken())
    def p(s, text, word):
        return s.user(text, word).gen("a").gen_int("n").select("c", ["x", "y"])

    r = p.bind(word="!").run_batch(spark.createDataFrame([(1, None), (2, "t")], "id long, text string"), "text").orderBy("id").collect()
    assert [(x.a, x.n, x.said[:-1]) for x in r] == [(None, None, "<|user|>\n!\n"), (None, None, "<|user|>\nt!\n")] and all(x.c in ("x", "y") for x in r)


def test_processor_without_parameters(spark):
    df = spark.createDataFrame([([1.0, 2.0], None), (None, "{}"), ([], '{"by": 3}'), ([1.0], '{"by": 3}')], "s array<double>, p string")
    got = df.select(programs.processed(F.col("s"), F.col("p"), lambda s, p: np.asarray(s) * p.get("by", 1)).alias("s")).collect()
    assert [r.s for r in got] == [[1.0, 2.0], None, [], [3.0]]


def test_nearest_of_odd_vectors(spark, tmp_path, monkeypatch):
    """Against the SQL: ties, repeated ids, components or vectors that are null or missing, values beyond exact products; strips and runs don't matter."""
    import duckdb

    from tessera.plans import serving

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 4, 5) / 2], 0) for i in range(0, 3000, 20)]
    rows += [(200, [0.5] * 5, 0), (7, [0.5, None, 1.0, 0.25, 0.0], 0), (300, [None, 0.5, 0.5], 0), (8, None, 0), (9, [], 0), (500, None, 0), (None, [1.0] * 5, 0), (11, [2e6, 1.2344, -3e6, 0.5, 0.125], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, vec_id, score, rank FROM ({serving.ORACLES['topk_neighbours']})").fetchall()
    assert len(want) == 90
    for strip, run in ((2048, 65_536), (40, 7)):
        monkeypatch.setattr(ranking, "STRIP", strip)
        monkeypatch.setattr(ranking, "RUN", run)
        assert sorted(map(tuple, serving.topk_neighbours(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
