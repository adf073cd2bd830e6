"""Literal rows for the scalar functions, traps included."""

import hashlib
import json

from pyspark.sql import functions as F

from tessera.functions import answers, chat, models
from tessera.functions import text as tx
from tessera.operators import chains, curate, dedup, evals, mix, quality, ranking, tokens


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column.alias("y")).collect()]


def test_normalise(spark):
    got = values(spark, ["ＡＢＣ１２", "a　b", "a  b", " x​ ", "a\x1cb\r\n\tc", None, ""], tx.normalize_text(F.col("x")))
    assert got == ["ABC12", "a b", "a b", "x", "a b c", "", ""]


def test_script_ratio(spark):
    assert values(spark, ["中文ab", "", "abcd", "𠀀中"], tx.script_ratio(F.col("x"))) == [0.5, 0.0, 0.0, 0.5]
    assert values(spark, ["中中中ab", "", "中a"], tx.script_ratio_ok(F.col("x"))) == [True, False, False]
    assert values(spark, ["𠀀", "豈", "a"], tx.is_script_char(F.col("x"))) == [True, True, False]


def test_urls_and_lengths(spark):
    five = "http://a " * 5
    assert values(spark, [five, five + "https://b"], tx.too_many_urls(F.col("x"), 5)) == [False, True]
    assert values(spark, ["ab", "abc", " abc ", "abcd"], tx.length_ok(F.col("x"), 3, 3, stripped=True)) == [False, True, True, False]


def test_pii(spark):
    rows = ["call 13812345678", "电话13812345678", "me@a.org", "123456789012345", "12345678901234567X", "123456789012345678 9", "1234567890123", "12345678901234567Xa"]
    assert values(spark, rows, tx.has_pii(F.col("x"))) == [True, False, True, True, True, True, False, True]


def test_fingerprint_is_of_the_json_text(spark):
    rows = ['say "x"', "back\\slash", "line\nfeed\ttab/", "中文"]
    want = [hashlib.md5(json.dumps(r, ensure_ascii=False).encode()).hexdigest()[:16] for r in rows]
    assert values(spark, rows, tx.fingerprint(F.col("x"))) == want


def simhash(text):
    import regex

    v = [0] * 64
    for w in regex.findall(r"[\p{L}\p{N}_]+", text.lower()):
        h = int(hashlib.md5(w.encode()).hexdigest()[16:], 16)
        for i in range(64):
            v[i] += 1 if h >> i & 1 else -1
    n = sum(1 << i for i in range(64) if v[i] >= 0)
    return n - (1 << 64) if n >> 63 else n


def test_simhash(spark):
    rows = [(1, ""), (2, "one"), (3, "one two"), (4, "x² éa ‿ ½"), (5, "a b c a")]
    got = dict(dedup.simhash(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect())
    assert got == {i: simhash(t) for i, t in rows}
    assert got[1] == -1


def test_greedy_keeps_both_ends_of_a_chain(spark):
    ids = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert sorted(r[0] for r in dedup.greedy_survivors(ids, pairs).collect()) == [0, 2, 3, 5]


def test_allocation():
    assert mix.allocate({"a": 10, "b": 10}, {"a": 0.5, "b": 0.5}, 3) == {"a": 2, "b": 2}
    assert mix.allocate({"a": 1100, "b": 171739}, {"a": 0.4, "b": 0.6}, 172839) == {"a": 1100, "b": 171739}
    assert mix.allocate({"a": 0, "b": 5}, {"a": 1, "b": 1}, 4) == {"a": 0, "b": 4}
    assert mix.allocate({"a": 3, "b": 3}, {"a": 0, "b": 0}, 4) == {"a": 2, "b": 2}


def test_quality_reasons(spark):
    rows = [("中文" * 20, "", "好" * 50), ("中文" * 20, "abc", "好" * 50), ("", "", "好"), ("中" * 5, "", "好抱歉我不能")]
    d = spark.createDataFrame(rows, "i string, n string, o string")
    got = [r[0] for r in quality.judged(d, "o", "i", "n", lengths=((4, 99), (1, 99), (1, 99))).select("reject_reason").collect()]
    assert got == [None, "ratio", "empty", "pattern"]
    assert quality.judged(d, "o", "i", "n", optional_input=False).select("reject_reason").first()[0] == "ratio"


def test_chatml(spark):
    t = chat.chatml(F.lit(" s "), F.lit("q"), F.lit("a"))
    two = F.concat(t, F.lit(f"\n{chat.BEGIN}{chat.USER}\nlater\n{chat.END}"))
    no_user = F.lit(f"{chat.BEGIN}{chat.SYSTEM}\ns\n{chat.END}{chat.BEGIN}{chat.ASSISTANT}\na\n{chat.END}")
    got = spark.range(1).select(chat.parse_by_role(two).alias("x"), chat.parse_by_role(no_user).alias("y"), chat.parse_by_role(F.lit("none")).alias("z"), chat.parse_by_position(t).alias("p")).first()
    assert tuple(got.x) == ("q", "a") and tuple(got.y) == ("s", "a") and got.z is None and tuple(got.p) == ("s", "q", "a")


def test_templates(spark):
    d = chat.templates(spark).withColumn("turns", F.array(F.struct(F.lit(" q ").alias("human"), F.lit("a").alias("assistant"))))
    got = dict(d.select("template_name", chat.render(F.col("turns"), F.col("default_system"))).collect())
    assert len(got) == 24 and got["chatglm2"] == "[Round 1]\n\n问：q\n\n答：a" and got["mistral"] == "<s>[INST]q[/INST]a</s>" and got["default"] == "User: q\nAssistant: a </s>"


def test_answers(spark):
    assert values(spark, ["it is 1,234", "none", "007", "3 or 12"], answers.last_integer(F.col("x"))) == [1234, answers.INVALID, answers.INVALID, 12]
    assert values(spark, ["Answer: B", "answer: b", "no"], answers.stated_choice(F.col("x"))) == ["B", "b", None]
    assert answers.boxed_text(r"x \boxed{\frac{1}{2}} y") == r"\frac{1}{2}"
    assert answers.math_equal("50%", "0.5") and answers.math_equal(r"\frac{1}{2}", "0.5") and answers.math_equal("(1, 2)", "(1,2.0)") and not answers.math_equal("1", "2")
    assert answers.math_answer("The answer is: 3.0.\nOther") == "3"


def test_text_pieces(spark):
    got = spark.range(1).select(
        tx.trim_overlap(F.lit("abcd"), F.lit("cdef")).alias("a"), tx.cut_at(F.lit("one STOP two"), "STOP").alias("b"), tx.printable_part(F.lit("a bc")).alias("c"), tx.printable_part(F.lit("中")).alias("d"),
        tx.split_reasoning(F.lit("<think>r</think> a")).alias("e"), tx.split_reasoning(F.lit("<think>only")).alias("f"), tx.remove_prefix(F.lit("xy"), "x").alias("g"), tx.remove_suffix(F.lit("xy"), "y").alias("h"),
    ).first()
    assert (got.a, got.b, got.c, got.d, tuple(got.e), tuple(got.f), got.g, got.h) == ("ef", "one ", "a ", "中", ("r", "a"), ("only", ""), "y", "x")


def test_tool_calls(spark):
    rows = ['<tool_call>{"name":"f","arguments":{"a":1}}</tool_call>', '[TOOL_CALLS] [{"name":"g","arguments":{}}]', '<|python_tag|>{"name":"h","parameters":{"b":2}}', "no call", '{"name":"k","arguments":{}}']
    got = values(spark, rows, tx.tool_calls(F.col("x")))
    assert [[(c.name, c.arguments) for c in r] for r in got] == [[("f", '{"a":1}')], [("g", "{}")], [("h", '{"b":2}')], [], [("k", "{}")]]


def test_packing_drops_a_rest_only_of_full_groups(spark):
    d = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [4, 5]), (2, 1, [9])], "g long, o long, ids array<int>")
    got = {(r.g, r.block_no): r.ids for r in tokens.packed(d, "g", "o", "ids", 2).collect()}
    assert got == {(1, 0): [1, 2], (1, 1): [3, 4], (2, 0): [9]}


def test_preference_cuts(spark):
    a = lambda n: F.array_repeat(F.lit(1), n)
    got = spark.range(1).select(tokens.preference(a(10), a(6), a(3), 8, 4).alias("x")).first().x
    assert len(got.chosen_ids) == 8 and len(got.rejected_ids) == 7 and got.chosen_labels[:4] == [-100] * 4


def test_statistics(spark):
    d = spark.createDataFrame([("q", 1.0), ("q", 0.0), ("r", 1.0), ("r", 1.0)], "q string, s double")
    assert evals.standard_error(d, "q", F.col("s")).first().accuracy == 0.75
    got = spark.range(1).select(evals.pass_at_k(F.lit(5), F.lit(2), 1).alias("a"), evals.pass_at_k(F.lit(5), F.lit(4), 2).alias("b"), evals.pass_at_k(F.lit(1), F.lit(1), 2).alias("c"), evals.pass_at_k(F.lit(5), F.lit(0), 2).alias("d")).first()
    assert abs(got.a - 0.4) < 1e-9 and got.b == 1.0 and got.c is None and got.d == 0.0
    v = spark.createDataFrame([("g", 1, "b"), ("g", 2, "a"), ("g", 3, "a"), ("g", 4, "b")], "g string, o long, v string")
    assert evals.majority(v, "g", "o", "v").first().v == "b"


def test_packs_are_balanced(spark):
    d = spark.createDataFrame([("l", i, float(w)) for i, w in enumerate([9, 1, 5, 5])], "l string, i long, w double")
    got = {r.i: r.pack for r in ranking.balanced_packs(d, "l", "i", "w", 2).collect()}
    assert got[0] == got[1] and got[2] == got[3]


def test_retries():
    seen = []

    def call(_):
        seen.append(1)
        if len(seen) < 3:
            raise ValueError("no")
        return "yes"

    assert models.retried(call, "p", sleep=lambda _: None) == ("yes", None)
    assert models.retried(lambda _: 1 / 0, "p", sleep=lambda _: None)[0] is None


def test_one_pass_of_patterns_equals_each(spark):
    rows = ["Only For educational use", "only for", "AS AN AI model", "as an artist", "i can’t help with that", "抱歉，我不能", "抱歉\n不能", "侵权", "无法协助", "加微信", "", "I am not a Doctor", "xI cannot assistx"]
    d = spark.createDataFrame([(r,) for r in rows], "x string")
    each = F.lit(False)
    for p in tx.REFUSALS:
        each = each | F.col("x").rlike(f"(?d){p}")
    got = d.select(tx.matches_any(F.col("x")).alias("a"), each.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a for r in got) == 9
    assert values(spark, ["b1", "x"], tx.matches_any(F.col("x"), (r"\d", "(?i)Q"))) == [True, False]


def test_chains_of_any_length_and_rings(spark):
    links = [(i, i + 1) for i in range(100)] + [(100, 100), (200, 201), (201, 202), (202, 200), (203, 201), (300, 301), (400, None)]
    got = {r.id: (r.end, r.hops, r.ring) for r in chains.resolved(spark.createDataFrame(links, "id long, to long")).collect()}
    assert all(got[i] == (100, 100 - i, False) for i in range(101)) and all(got[i] == (None, None, True) for i in (200, 201, 202, 203))
    assert got[300] == (301, 1, False) and got[400] == (400, 0, False)


def test_greedy_choice_of_long_answers(spark):
    long = [-0.1] * 80
    d = spark.createDataFrame([([long + [-0.2], long + [-0.1]],), ([[-1.0], [-0.5, -2.0]],)], "l array<array<double>>")
    assert [r[0] for r in d.select(answers.greedy_choice(F.col("l"))).collect()] == [1, 1]


def test_the_last_option_named_wins(spark):
    o = F.array(*[F.lit(x) for x in ("red", "green", "blue", "grey")])
    assert values(spark, ["I think that red or blue might do but finally red", "it may well be a red or a blue one"], answers.chosen_option(F.col("x"), o)) == ["A", "C"]


def test_python_calls(spark):
    rows = ['[f(a=1, b="x;y"), g()]', "[not a call]", '<|python_tag|>{"name": "f", "arguments": {"q": "a;b"}}; {"name": "g", "arguments": {}}']
    got = values(spark, rows, tx.tool_calls(F.col("x")))
    assert [[c.name for c in r] for r in got] == [["f", "g"], [], ["f", "g"]] and json.loads(got[0][0].arguments) == {"a": 1, "b": "x;y"}


def test_curation_modes_by_the_counts(spark):
    rows = [(i, "hit", 0, f"hit {i}") for i in range(11)] + [(100 + i, "general", 1, f"text {i if i % 80 else 0}") for i in range(240)]
    d = spark.createDataFrame(rows, "id long, source string, rank int, text string")
    run = lambda **more: curate.curated(d, {"hit": 0.4, "general": 0.6}, 300, F.length("text") > 6, **more)
    repeats = 240 - len({t for _, s, _, t in rows if s == "general"})
    assert repeats == 2
    assert run(filtering=False, near=None).count() == 251 - repeats
    assert run(filtering=False, deduplicating=False).count() == 300
    kept = run(near=None).collect()
    assert len(kept) == len({r.fp for r in kept}) == len({t for *_, t in rows if len(t) > 6})


def test_literals_that_patterns_need(spark):
    assert tx.needed("(?i)I (?:can not|cannot) Help") == ["i can not help", "i cannot help"]
    assert tx.needed("ab(?:cd)?|x.*yz") == ["ab", "yz"]
    assert [tx.needed(p) for p in (r"\d", "a.b", "ab|", "ab(?i)cd", "ab{0}cd", "(ab|cd)*e")] == [None] * 6
    # texts without any of the literals never reach the patterns, which are slow to fail
    plan = spark.range(1).select(tx.matches_any(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "i cannot assist" in plan
    texts = ["I CAN NOT ASSIST", "i can’t HELP with that", "As an AI model", "请咨询一下医生", "请咨询他", None, "fine"]
    assert values(spark, texts, tx.matches_any(F.col("x"))) == [True, True, True, True, False, None, False]


def test_script_ratio_counts_what_the_script_leaves(spark):
    assert values(spark, ["aé ɏ1𠀀", None, "ab 中"], tx.script_ratio(F.col("x"), "latin")) == [0.5, None, 0.5]
    plan = spark.range(1).select(tx.script_ratio(F.col("id").cast("string"), "latin").alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^A-Z" not in plan


def test_nfkc_of_all_characters_and_who_meets_python(spark):
    import unicodedata

    from pyspark.sql import types as T

    chars = [chr(i) for i in range(0x3100) if i] + ["ＡＢ１２", "e\u0301", "한\u11a8", "中\u0301", "é\u0323", "\U0002f800", None, ""]
    texts = [c and f"a{c}é" for c in chars] + chars
    assert values(spark, texts, tx.to_halfwidth(F.col("x"))) == [t and unicodedata.normalize("NFKC", t) for t in texts]
    seen = F.pandas_udf(lambda s: s.map(lambda x: f"python {x}", na_action="ignore"), T.StringType())
    kept, tx._nfkc = tx._nfkc, seen
    try:
        assert values(spark, ["plain", "Müßiggang – «né» 中文", "ﬁ", None], tx.to_halfwidth(F.col("x"))) == ["plain", "Müßiggang – «né» 中文", "python ﬁ", None]
    finally:
        tx._nfkc = kept
