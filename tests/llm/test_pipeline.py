"""The pipeline stage by stage, against what each stage's decisions mean for its own input."""

import random
from collections import Counter

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, brute_lines, brute_links, filled, odd_docs, words

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, at = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        at.append(name)
        if name != "bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))} == {r.doc_id for r in after}
        elif name == "line_dedup":
            assert brute_lines([(r.doc_id, r.text) for r in after]) == 0
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "ngram_jaccard":
            groups = brute_links([(r.doc_id, r.text) for r in before], 5, 80)
            assert Counter(r.doc_id for r in after) == Counter({i: 1 for i, _, c in groups if i == c})
        elif name == "mix_sources":
            sizes, got = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(words(r.text))
            for r in after:
                got[r.source] += len(words(r.text))
            want = filled(sizes, (5, 2, 1), 1.5 * sum(sizes.values()))
            longest = {s: max(len(words(r.text)) for r in before if r.source == s) for s in sizes}
            assert all(abs(got[s] - want[s]) <= longest[s] for s in sizes)
            assert max(Counter(r.doc_id for r in after).values()) <= 2
        else:
            lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert len(before) == len(after) and all(r.round_trip for r in after)
            texts = {r.doc_id: r.text for r in before}
            assert all(list(r.ids) == lib.encode(texts[r.doc_id], add_special_tokens=False).ids for r in after)
    assert at == ["language_id", "line_dedup", "ngram_jaccard", "mix_sources", "bpe"]


def test_columns_of_any_name(spark):
    rng = random.Random(11)
    names = ("_id", "dropped", "_score", "_pred", "_h", "_th", "_key", "_n", "_k", "key", "th", "h", "size", "target", "pass", "kept", "rank", "tessera_0", "Tessera_1", "component_id")
    docs = spark.createDataFrame(odd_docs(rng), DOCS).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in names})
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        for r in got.collect():
            i = "?" if r.doc_id is None else r.doc_id
            assert all(r[c] == f"{c} {i}" for c in names) and (name == "line_dedup" or (r.doc_id, r.text) in before), name


def test_near_duplicates_of_odd_documents(spark):
    rows = odd_docs(random.Random(9))
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(rows, DOCS), SF).collect())
    left = {(i, t) for i, t, *_ in rows}
    # the three near copies of document 3 go, whose shingles are alike; repeated rows are one
    base = rows[4][1]
    gone = {(4, base), (5, base + " more"), (None, base)}
    kept = min(((i, t) for i, t in left if t and t.startswith(base[:40])), key=lambda x: (x[0] is not None, x[0] or 0))
    left -= (gone | {(3, base)}) - {kept}
    assert got == Counter(left)


def test_odd_and_empty_documents(spark, tmp_path):
    for k, rows in enumerate((odd_docs(random.Random(9)), [])):
        (tmp_path / str(k)).mkdir()
        docs = spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1))
        docs.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / str(k)))
        assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)
        got, texts = out.collect(), {(i, len(t or "")) for i, t, *_ in rows}
        assert bool(got) == bool(rows) and all(r.round_trip for r in got)
        # a third pass never; nulls and blank texts go at the first stage
        assert max(Counter((r.doc_id, tuple(r.ids)) for r in got).values(), default=0) <= 2
        assert not {r.doc_id for r in got} & {0, 1, 2} and {r.doc_id for r in got} <= {i for i, _ in texts}
