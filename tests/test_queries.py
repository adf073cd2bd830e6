"""Every query with SQL gives the SQL's rows on the smallest tables; results don't depend on the number of partitions."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_the_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["near_dup_survivors", "pack_blocks", "seeded_shuffle", "longest_prefix_match"])
def test_partitions_do_not_matter(spark, name):
    seen = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, registry.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_no_oracle_without_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_json_repair_of_long_properties(spark, tmp_path):
    from tessera.plans import curation

    props = '{"pad": "' + "x" * 20_000 + '", "k": 7}'
    spark.createDataFrame([(1, props), (2, '{"k": 3}')], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.k for r in curation.json_repair(spark, str(tmp_path)).collect()} == {1: 7, 2: 3}


def test_curation_modes_with_null_and_empty_texts(spark, tmp_path):
    docs = [(i, f"text {i // 2}", f"src{i % 3}") for i in range(240)] + [(1000, None, "src0"), (1001, "", "src1"), (1002, " ", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["curation_modes"])
    got = registry.QUERIES["curation_modes"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_near_survivors_meet_by_the_least_ids(spark, monkeypatch):
    import random

    from tessera.operators import dedup

    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.choice((0, 1, 3, 7, 15, 31, 63, -1, -2))) for i in rng.sample(range(1000), 200)]
    kept = []
    for i, g, s in sorted(rows):
        if not any(g == h and bin((s ^ t) & (2**64 - 1)).count("1") <= 3 for _, h, t in kept):
            kept.append((i, g, s))
    rows += [(2000, None, 5), (2001, None, 5)]
    kept += rows[-2:]
    d = spark.createDataFrame(rows, "id long, g string, sig long")
    pairs, greedy = [], dedup.greedy_survivors
    monkeypatch.setattr(dedup, "greedy_survivors", lambda ids, p, id: pairs.append(p.count()) or greedy(ids, p, id))
    assert sorted(r.id for r in dedup.near_survivors(d, "id", ("g",)).collect()) == [i for i, *_ in kept]
    assert pairs[0] <= 2 * 36


def test_near_dup_pairs_compute_signatures_once(spark):
    from tessera.plans import curation

    plan = curation.near_dup_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
