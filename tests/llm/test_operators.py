"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tokenizers
from pyspark.sql import functions as F

from tessera.llm import bpe, components, jaccard, language, licenses, lines, media, mixing, personal_data, queries, sharding, vector_search
from tessera.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORDS = "the a of cat dog sat on mat runs over blue river stone wind light green leaf far near old".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


def odd_docs(rng):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids."""
    base = prose(rng, 60)
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n", None, "a"), (3, base, "en", None), (4, base, "en", "a"), (4, base, "en", "a"), (5, base + " more", "de", "b"), (None, base, "en", "b"), (None, None, "en", "b"), (6, "one", "fr", "b"), (7, "one two", "fr", "b"), (8, prose(rng, 5000), "en", "c"), (9, "ÄÖ　é 漢字 word😀", "de", "c"), (4, prose(rng, 20), "es", "a")]
    return [(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_docs(random.Random(5)), DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# op1


def brute_top(rows, k, step):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    q = {i: np.floor(np.array(v, np.float64) * 256).astype(np.int64) for i, v in good}
    out = {}
    for i, v in q.items():
        if i % step == 0:
            s = sorted((-int(v @ w), j) for j, w in q.items() if j != i and len(w) == len(v))[:k]
            out.update({(i, r + 1): (j, -n) for r, (n, j) in enumerate(s)})
    return out


@pytest.mark.parametrize("blocks", [(4, 8), (1024, 4096)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 8]) for i in range(60)]
    rows += [(5, rows[5][1]), (100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (None, [1.0] * 6), (110, [0.5, 0.25])]
    d = spark.createDataFrame(rows, "id long, e array<float>").select("id", vector_search.quantise(F.col("e")).alias("v"))
    got = vector_search.top_k(d, d.where("id % 10 = 0"), query_block=blocks[0], vector_block=blocks[1])
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()} == brute_top(rows, 5, 10)


def test_top_k_of_nothing(spark):
    d = spark.createDataFrame([], "id long, v array<long>")
    assert vector_search.top_k(d, d).count() == 0


def test_top_k_copies_no_block(spark):
    """Of many blocks, none is copied for those that it meets; ties and own rows over blocks of a strip."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 8]) for i in range(700)]
    d = spark.createDataFrame(rows, "id long, e array<float>").select("id", vector_search.quantise(F.col("e")).alias("v"))
    got = vector_search.top_k(d, d.where("id % 10 = 0"), query_block=3, vector_block=5)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()} == brute_top(rows, 5, 10)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("big", [3, 5000, 2**20, 2**29])
def test_best_of_blocks(big):
    rng = np.random.default_rng(big)
    x, q = rng.integers(-big, big + 1, (300, 5)), rng.integers(-big, big + 1, (40, 5))
    ids, q_ids = np.sort(rng.integers(0, 250, 300)), rng.integers(0, 250, 40)
    best = vector_search.Best(q_ids, 5)
    for at in range(0, 300, 70):
        best.meet(vector_search.narrow(q), vector_search.narrow(x[at : at + 70]), ids[at : at + 70], 4)
    for i in range(40):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], v)), int(n)) for v, n in zip(x, ids) if n != q_ids[i])[:5]
        assert [(-int(s), int(n)) for s, n in zip(best.scores[i], best.ids[i])] == want


def test_wide_scores_are_exact():
    big = 2**30
    x = np.array([[big, big], [big, big - 1]], np.int64)
    assert vector_search.scan(x[:1], np.array([9]), x, np.array([1, 2]), 1, 4) == [(9, 1, 2 * big * big)]


# op2


def test_licenses(spark):
    rng = random.Random(2)
    notice = licenses.TEMPLATES["GPL-notice"]
    bent = notice.replace("free software", "FREE  software").replace("\n", " ").replace("either version 3", "either\n# version 3")
    rows = [(1, None), (2, ""), (3, prose(rng, 300)), (4, prose(rng, 40) + "\n" + licenses.TEMPLATES["MIT"] + "\n" + prose(rng, 40)), (5, "é😀 " + bent), (6, licenses.TEMPLATES["MIT"] + " " + prose(rng, 4000) + " " + licenses.TEMPLATES["Apache-2.0"]), (6, licenses.TEMPLATES["MIT"]), (7, "Released under the")]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter((r[0], r[1]) for r in got) == Counter([(4, "MIT"), (5, "GPL-notice"), (6, "MIT"), (6, "Apache-2.0"), (6, "MIT")])
    text = dict(rows[:6])
    for i, name, coverage, _, a, b in got:
        assert 0.85 <= coverage <= 1
        if i in (4, 5):
            assert text[i][a:b].lower().startswith(licenses.words(licenses.TEMPLATES[name])[0][0])


# op3


def sharded(rows):
    counts = Counter(r.shard for r in rows)
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    return counts


def test_shards(spark, odd):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc") * (i % 7) if i % 4 else "same", None, None, None) for i in range(200)] + odd_docs(rng)
    d = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("g", F.lit(1))
    got = sharding.shard(d, 8).collect()
    counts = sharded(got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted(r.size for r in got) == sorted(16 + len((t or "").encode()) for _, t, *_ in rows)
    assert all((r.text_crc32 is None) == (r.group_id is None) for r in got)


def test_groups_stay_together_where_they_fit(spark):
    rows = [(i, f"t{i // 5}" if i < 200 else f"alone{i}") for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.group_id].add(r.shard)
    assert sum(len(s) > 1 for s in homes.values()) <= 2


def test_a_group_of_many_shards_gathers(spark):
    rows = [(i, "hot" if i < 10_000 else f"alone{i}") for i in range(20_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert set(sharded(got).values()) == {1000}
    hot = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot"))
    # ten shards hold it; a few documents fall beside them by their hashes
    assert sum(hot.values()) == 10_000 and sum(n * n for n in hot.values()) >= 0.85 * 10 * 1000**2


def test_few_or_no_rows_to_shard(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard(d, 40).collect()) == [0, 0]
    assert sharding.shard(d.where("doc_id < 0"), 40).count() == 0


# op4 and components


def brute_links(rows, width=3, percent=90):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = lambda g: min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
    return Counter((rows[i][0], len(sets[i]), least(g)) for g in groups.values() for i in g)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 12)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(4)
    seed = prose(rng, 120)
    rows = [(i, edited(rng, seed, i % 6)) for i in range(80)] + [(100 + i, prose(rng, rng.randrange(1, 90))) for i in range(60)]
    rows += [(i, t) for i, t, *_ in odd_docs(rng) if i is None or i > 8 or i < 3] + [(200 + i, "Short Text") for i in range(3)] + [(300, "short text")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, cid int")
    got = Counter(map(tuple, jaccard.link(d, width=width, percent=percent).collect()))
    assert got == brute_links(rows, width, percent)


def test_jaccard_join_of_nothing(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (202, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[202] == 200 and len(got) == 41 + 30 + 3


def test_common_shingles_come_last_whatever_the_sketch(spark):
    """Where the sketch is too small to tell what is common, a sample of the texts does, so no bucket of the common passage is left."""
    rng = random.Random(11)
    passage = prose(rng, 12)
    rows = [(i, f"{' '.join(str(rng.random()) for _ in range(40))} {passage}") for i in range(2500)]
    docs, scratch = spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)
    known = jaccard.Orders(np.full((2, 16), 2500 * 52 // 16, np.int32))

    def largest():
        p = jaccard.postings(docs, "text", 3, 90, spark.sparkContext.broadcast(known), 2)
        return p.groupBy("tok").count().agg(F.max("count")).collect()[0][0]

    assert largest() > jaccard.CROWD
    known.know(*jaccard.frequent(docs, "text", 3, spark.sparkContext.broadcast(known), scratch))
    assert largest() == 1
    assert jaccard.link(docs.limit(200).union(docs.limit(1)), bits=6).where("component_id <> doc_id").count() == 0


def test_orders_are_sent_as_a_byte_a_place():
    known = jaccard.Orders(np.full((2, 1 << 20), 70, np.int32))
    known.know(np.arange(1, 1001, dtype=np.uint64), np.full(1000, 64))
    sent = pickle.dumps(known)
    assert len(sent) < (2 << 20) + 100_000
    assert (pickle.loads(sent).level(np.array([5, 5000], np.uint64)) >> np.uint64(56)).tolist() == [48, 0]


def test_orders_reach_the_driver_as_levels(spark):
    rng, scratch = random.Random(22), Scratch(spark)
    docs = spark.createDataFrame([(i, prose(rng, 80)) for i in range(300)], "doc_id long, text string").repartition(3)
    seen = scratch.save(jaccard.survey(docs, "doc_id", "text", 1, 20).where("part IS NOT NULL").select("part", "task", "counts"), "seen")
    tracemalloc.start()
    known = jaccard.gathered(seen, 20, scratch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.zeros((jaccard.SLICES, (2 << 20) // jaccard.SLICES), np.int64)
    for r in seen.collect():
        counts[r.part] += np.frombuffer(r.counts, "<i4")
    assert (known.places == jaccard.Orders(counts.reshape(2, -1)).places).all() and known.places.max() > 0
    assert most < 12 << 20  # 2 MB of levels and what carries them


# op5


def brute_lines(rows, kept=None):
    """How many lines go; kept: gets the kept line's key of each that goes, by key and line number (rows told apart by their keys)."""
    norm = lambda s: regex.sub(r"[^\p{L}\p{N}]+", " ", s).strip(" ").lower()
    seen = defaultdict(set)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if n := norm(line):
                seen[n].add((i, t, k))
    names = sorted(seen)
    sets = [frozenset(n[i : i + 5] for i in range(len(n) - 4)) or frozenset([n]) for n in names]
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if 100 * x >= 80 * (len(sets[i]) + len(sets[j]) - x):
                parent[find(i)] = find(j)
    size, members = Counter(), defaultdict(list)
    for i, n in enumerate(names):
        size[find(i)] += len(seen[n])
        members[find(i)] += [(-1 if key is None else key, k) for key, _, k in seen[n]]
    if kept is not None:
        for all_ in members.values():
            kept.update({at: min(all_) for at in all_ if at != min(all_)})
    return sum(n - 1 for n in size.values())


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = [prose(rng, rng.randrange(1, 30)) for _ in range(40)]
    pool += [p[:-1] + "!" for p in pool[:10]] + [p.upper() for p in pool[5:12]] + ["", "--", "ab", "a-b"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8)))) for i in range(60)] + [(70, None), (71, ""), (72, "\n\n")]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    got = lines.report(d).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_lines for r in got} == {i: len(t.split("\n")) if t is not None else 0 for i, t in rows}
    want = {}
    assert sum(len(r.dropped) for r in got) == brute_lines(rows, want)
    assert {(r.doc_id, x.line_no): (x.kept_key, x.kept_line) for r in got for x in r.dropped} == want
    kept = lines.dedup(d).collect()
    assert brute_lines([(r.doc_id, r.text) for r in kept]) == 0 and {70, 71, 72} <= {r.doc_id for r in kept} and kept[0].__fields__ == d.columns


def test_line_dedup_odd(spark, odd):
    assert lines.report(odd).count() == odd.count()
    assert lines.report(odd.where("1 = 0")).count() == 0
    assert lines.dedup(odd.where("1 = 0")).count() == 0


def line_drops(spark, texts):
    """How many lines of one document each are dropped, and how many brute force drops."""
    rows = list(enumerate(texts))
    return sum(len(r.dropped) for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), brute_lines(rows)


def test_lines_that_repeat_themselves_or_have_long_tokens(spark):
    rng = random.Random(12)
    token = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    once = "the cat sat on the mat while a dog ran over the old blue river"
    tokens = [token() for _ in range(10)]
    changed = [t if k < 4 else t[:29] + "#" for k, t in enumerate(tokens)]
    texts = [once, f"{once} {once}", "buy now " * 4, "buy now " * 40, " ".join(tokens), " ".join(changed), prose(rng, 12), prose(rng, 40)]
    got, want = line_drops(spark, texts)
    assert got == want == 3


def test_lines_without_spaces(spark):
    rng = random.Random(13)
    make = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    chinese, letters = make(300), "".join(rng.choice("abcdefghij") for _ in range(300))
    texts = [chinese, "x" + chinese[1:], letters, "z" + letters[1:], chinese[:150] + "y" + chinese[151:]]
    # one beginning and different ends; short lines that differ near an end
    texts += [letters[:20] + make(60) for _ in range(6)] + ["abcdefghijklmn", "abcdefghijklmx", "xbcdefghijklmn"]
    got, want = line_drops(spark, texts)
    assert got == want == 5


def test_lines_with_many_others_between(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 16, raising=False)
    rng = random.Random(14)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = make(30)
    texts = [common + make(40) for _ in range(120)]
    copies = [t[:68] + "#%" for t in texts[::10]]
    got, want = line_drops(spark, texts + copies)
    assert got == want == len(copies)


def test_crowded_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lines, "SAMPLE", 2)
    monkeypatch.setattr(lines, "BLOCK", 16)
    rng = random.Random(17)
    seed = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))
    copies = [seed[:p] + rng.choice("xyz") + seed[p + 1 :] for p in range(5, 195, 2)]
    got, want = line_drops(spark, copies + [prose(rng, 30) for _ in range(20)])
    assert got == want >= len(copies) - 1


def test_lines_near_the_threshold_seldom_become_pairs(spark):
    rng = random.Random(21)
    base, texts = prose(rng, 90).split(" "), []
    for k in range(60):  # each two share some 0.7 of their shingles, and every fifth has a copy that links
        other = list(base)
        for at in rng.sample(range(90), 5):
            other[at] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(len(other[at])))
        texts += [" ".join(other)] + [" ".join(other) + " zx"] * (k % 5 == 0)
    d = spark.createDataFrame(list(enumerate(texts)), "h long, norm string")
    none, scratch = spark.createDataFrame([], "v long, root long"), Scratch(spark)
    signed = scratch.save(lines.signed(d).select("h", *lines.SCALES), "signed")
    members = scratch.save(signed.select("h", F.explode(F.concat(*[lines.bands(F.col(s)) for s in lines.SCALES])).alias("band")), "members")
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert lines.apart(members, none, d, signed, 80, scratch).count() <= len(want) + 60
    # a pair meets in one bucket, however many the two share
    left = members.join(members.groupBy("band").agg(F.count("*").alias("members")), "band").withColumn("root", F.col("h"))
    left, maps = scratch.save(left, "left"), scratch.save(lines.bitmaps(d.select("h"), d, signed), "maps")
    met = [tuple(r) for r in lines.meetings(left, maps, 80).collect()]
    assert len(met) == len(set(met)) and want <= set(met) and len(want) >= 12


def test_templated_lines(spark):
    rng = random.Random(18)
    rows = [f"Order {rng.randrange(10**6)} of {prose(rng, 14)} was sent to {prose(rng, 2)} on day {rng.randrange(400)}" for _ in range(150)]
    rows += [" ".join(w if rng.random() > 0.03 else rng.choice(WORDS) for w in r.split(" ")) for r in rows for _ in range(3)]
    got, want = line_drops(spark, rows)
    assert want > 100 and got >= 0.98 * want


def test_lines_equal_but_for_punctuation(spark):
    texts = ["Click here!", "click here.", "- item one", "* item one", "Menu", "Menu\r", "\tMenu", "a-b", "ab"]
    got, _ = line_drops(spark, texts)
    assert got == 4


def test_scales_of_signatures_meet(spark):
    rng = random.Random(19)
    letters = "abcdefghijklmnopqrstuvwxyz   "
    rows = []
    for i in range(600):
        line = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 160)))
        at = rng.randrange(len(line))
        rows += [(i, line), (i, line[:at] + rng.choice(letters) + line[at + 1 :]), (i, line + rng.choice(letters) * 3)]
    d = spark.createDataFrame(rows, "i long, line string").select("i", lines.normal(F.col("line")).alias("norm"))
    found, linked, missed = defaultdict(list), 0, 0
    for r in lines.signed(d).select("*", *[lines.bands(F.col(s)).alias(f"b{s}") for s in lines.SCALES]).collect():
        found[r.i].append(r)
    for a, *others in found.values():
        for b in others:
            x, y = ({r.norm[k : k + 5] for k in range(len(r.norm) - 4)} or {r.norm} for r in (a, b))
            if 100 * len(x & y) >= 80 * len(x | y):
                linked += 1
                assert any(a[s] and b[s] for s in lines.SCALES)
                missed += not any(set(a[f"b{s}"]) & set(b[f"b{s}"]) for s in lines.SCALES)
    assert linked > 500 and missed <= 0.02 * linked


# op6


def test_bpe_equals_the_library(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(7)
    signs = "ab ctheing'sll  \t\n\r　\x1c\x85é漢字😀½²1234567!?.-_|<>́​"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(1000, "a" * 3000), (1001, "<|endoftext|>x<|endoftext|"), (1002, None), (1003, ""), (1004, " " * 2000), (1005, "".join(rng.choice("ehtins") for _ in range(4000)))]
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(d, path), path).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, lib.decode(ids, skip_special_tokens=False))
    assert bpe.decode(bpe.encode(odd.where("1 = 0"), path), path).count() == 0


def test_bpe_query(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op6_bpe(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# op7


def test_image_copies(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 120")
    g = media.gallery(d)
    more = spark.createDataFrame([(9001, None), (9002, b"not an image"), (9003, b"not an image"), (9004, b"P5 3 3 255\n123456789"), (None, b"x")], g.schema)
    got = {r.media_id: r for r in media.classes(g.union(more).union(more).withColumn("f", F.lit(1))).collect()}
    copies = [i for i in got if i is not None and i % 2 == 1 and i < 9000]
    assert sum(got[i].class_id == got[i - 1].class_id for i in copies) >= 0.9 * len(copies)
    originals = [got[i].class_id for i in got if i is not None and i % 2 == 0 and i < 9000]
    assert len(set(originals)) >= 0.95 * len(originals)  # some vectors are nearly alike
    assert got[9002].class_id == got[9003].class_id == 9002 and got[9001].class_id == 9001 and got[None].class_id is None
    assert media.classes(g.where("1 = 0")).count() == 0


def test_copies_with_many_others_in_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 8)
    rng = random.Random(15)
    bits = [(rng.getrandbits(62), rng.getrandbits(62)) for _ in range(8)]  # all images have the same eight patterns, elsewhere
    places = [[(rng.randrange(500), rng.randrange(500)) for _ in bits] for _ in range(12)]
    copies = rng.sample(range(12), 12)
    rows = [(i, *at, 0, 0, *d) for i, k in enumerate([*range(12), *copies]) for at, d in zip(places[k], bits)]
    f = spark.createDataFrame(rows, f"id long, {media.FEATURES}")
    got = {tuple(r) for r in media.linked(f, 12, 4, Scratch(spark)).collect()}
    assert got == {(k, 12 + i) for i, k in enumerate(copies)}


def test_copies_are_found_in_turns(spark, monkeypatch):
    monkeypatch.setattr(media, "COMPARED", 600, raising=False)
    seen, agreed = [], media.agreed
    monkeypatch.setattr(media, "agreed", lambda pairs, n: seen.append(pairs.count()) or agreed(pairs, n))
    rng = random.Random(23)
    bits = [(rng.getrandbits(62), rng.getrandbits(62)) for _ in range(8)]
    places = [[(rng.randrange(500), rng.randrange(500)) for _ in bits] for _ in range(12)]
    copies = rng.sample(range(12), 12)
    rows = [(i, *at, 0, 0, *d) for i, k in enumerate([*range(12), *copies]) for at, d in zip(places[k], bits)]
    got = [tuple(r) for r in media.linked(spark.createDataFrame(rows, f"id long, {media.FEATURES}"), 12, 4, Scratch(spark)).collect()]
    assert sorted(got) == sorted((k, 12 + i) for i, k in enumerate(copies))
    assert 3 * max(seen[1:]) < sum(seen[1:])


def test_crop_of_a_large_image(spark):
    rng = np.random.default_rng(16)
    large = np.kron(rng.integers(0, 256, (50, 50)), np.ones((8, 8))).astype(np.uint8)
    images = [(1, media.to_pgm(large)), (2, media.to_pgm(large[200:300, 120:220])), (3, media.to_pgm(np.kron(rng.integers(0, 256, (12, 12)), np.ones((8, 8)))))]
    got = {r.media_id: r.class_id for r in media.classes(spark.createDataFrame(images, "media_id long, image binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_pgm():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.from_pgm(media.to_pgm(x)) == x).all() and (media.from_pgm(b"P5 # c\n4 3\n255\n" + x.tobytes()) == x).all()
    assert all(media.from_pgm(b) is None for b in (None, b"", b"P5", b"P5 2 2 255\nabc", b"P6 1 1 255\na", b"P5 #"))


# op8


def filled(sizes, weights, budget):
    """Targets by raising all levels and stopping those at their cap, over and over."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, budget, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def brute_mix(rows):
    """What each document gives, word by word: all words of all copies by virtual finish, up to the budget (small sources: a packet is a word)."""
    key = lambda r: (hashlib.md5(("mix" + ("null" if r[0] is None else str(r[0]))).encode()).hexdigest(), -1 if r[0] is None else r[0], len(words(r[1])))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = filled(sizes, mixing.WEIGHTS, 1.5 * sum(sizes.values()))
    queue, taken = [], Counter()
    for s in sizes:
        before = 0
        for n, r in enumerate(sorted((r for r in rows if r[3] == s), key=key)):
            size = len(words(r[1]))
            for k in range(2):
                queue += [((before + w + 1 + k * sizes[s]) / target[s], *key(r)[:2], "" if s is None else "x" + s, before + k * sizes[s], w, (s, n)) for w in range(size)]
            before += size
            taken[(s, n)] += 0
    for q in sorted(queue)[: int(1.5 * sum(sizes.values()))]:
        taken[q[-1]] += 1
    order = {s: sorted((r for r in rows if r[3] == s), key=key) for s in sizes}
    return [(order[s][n][0], len(words(order[s][n][1])), x) for (s, n), x in taken.items()]


def test_packets_of_long_documents(spark):
    rows = [(i, "w " * 6000, None, "ab"[i % 2], None) for i in range(4)] + [(10 + i, "w " * 50, None, "a", None) for i in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= max(1, r.target / mixing.PACKETS) + 1 for r in got) and sum(taken.values()) == int(1.5 * 25_000)


def test_mix(spark, odd):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(40)), None, rng.choice(["a", "b", "c", "d", "é", None, ""]), None) for i in range(300)] + odd_docs(rng)
    d = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    got = mixing.mix(d, rows_per_bucket=20).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want, taken = filled(sizes, mixing.WEIGHTS, 1.5 * sum(sizes.values())), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(want[s] - taken[s]) <= 1 for s in sizes) and sum(taken.values()) == int(1.5 * sum(sizes.values()))
    again = mixing.mix(d.repartition(5), rows_per_bucket=20).collect()
    assert Counter((r.doc_id, r.taken, r.size) for r in got) == Counter((r.doc_id, r.taken, r.size) for r in again)
    order = [r.finish for r in mixing.schedule(mixing.mix(d)).collect()]
    assert order == sorted(order)
    assert {(r.doc_id, r.size, r.taken) for r in got} == {(i, size, n) for i, size, n in brute_mix(rows)}
    plan = mixing.packets(d.limit(0).select("doc_id", F.lit(1).alias("size"), F.lit(0).alias("before"), F.lit(1).alias("source_size"), F.lit(1.0).alias("target")), 2)
    assert plan.count() == 0


def test_mix_of_nothing(spark, odd):
    assert mixing.mix(odd.where("1 = 0")).count() == 0
    assert [r.taken for r in mixing.mix(odd.where("doc_id < 2")).collect()] == [0, 0]


# op9


def test_language(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate([None, "", "12 .", "漢字", "the"])]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(d.where(~language.held_out(F.col("doc_id"))))
    got = language.identify(d.withColumn("score", F.lit("clash")), model).where(language.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    few = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert [few[i].lang_pred == "und" for i in range(5)] == [True, True, True, False, False] and few[0].score == 0
    nothing = language.learn(d.where("1 = 0"))
    assert {r.lang_pred for r in language.identify(d.limit(5), nothing).collect()} == {"und"}
    one = language.learn(d.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(d.limit(5), one).collect()} == {"en"}


def test_language_does_not_depend_on_neighbours():
    m = language.Model.fit(np.stack([language.features(t) for t in ("the cat sat", "der hund ist", "le chat est", "el gato es")]), ["en", "de", "fr", "es"])
    texts = ["the dog sat on the mat", "das ist der", "x"]
    assert [a for a, _ in m.predict(texts)] == [m.predict([t])[0][0] for t in texts]


# op10


def brute_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and personal_data.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], personal_data.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(10)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789..--  ++()@@ab.x%") for _ in range(rng.randrange(40)))
        assert personal_data.base_spans(t) == brute_spans(t), t
    personal_data.base_spans("1" * 200_000 + "a@" * 50_000 + "+" + "1 " * 50_000)


def test_personal_data(spark, odd):
    card = "4337166598464399"
    rows = [(1, None), (2, ""), (3, "é mail me at a.b@c.example.com or +1 (988) 555-2485"), (4, f"pay {card} now"), (4, f"pay {card} now"), (5, f"two {card} {card} here"), (6, "version 3.0 and 1234567")]
    got = {r.doc_id: r for r in personal_data.find(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")).collect()}
    for i, t in rows:
        base = [(s.start, s.end, s.kind) for s in got[i].base]
        assert base == brute_spans(t) and set(base) <= {(s.start, s.end, s.kind) for s in got[i].spans}
    assert (got[3].n_email, got[3].n_phone, got[4].n_card, got[1].n_ip) == (1, 1, 1, 0)
    assert personal_data.find(odd.where("1 = 0")).count() == 0 and personal_data.find(odd).count() == odd.count()


def test_random_digits_are_not_cards():
    counts = {"card:+++00+:30": 160, "card:++-00+:30": 15, "card:+-+00+:30": 20, "card:+--00+:30": 135, "phone:+++00+:12": 50}
    sure = personal_data.train(counts, personal_data.reliabilities(counts))
    assert sure["card:+++00+:30"] > 0.9 > 0.5 > sure["card:+--00+:30"] and sure["phone:+++00+:12"] > 0.9
