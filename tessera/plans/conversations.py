"""Queries over `conversations`: role blocks, templates, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import chat
from tessera.operators import prompts
from tessera.operators.sequence import numbered


def _turns(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _pairs(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, human, assistant): each user turn that an assistant's follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, sf_dir).withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return t.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("human"), F.col("next_text").alias("assistant"))


def _firsts(spark, sf_dir) -> DataFrame:
    """(conv_id, system, user, assistant): the first turn of each role, empty without one."""
    first = lambda role: F.coalesce(F.min_by("text", F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    named = lambda role: F.when(F.max(F.col("role") == role), first(role)).otherwise(F.lit("")).alias(role)
    return _turns(spark, sf_dir).groupBy("conv_id").agg(*[named(r) for r in chat.ROLES])


def _blocks(spark, sf_dir) -> DataFrame:
    return _firsts(spark, sf_dir).select("conv_id", chat.chatml(F.col("system"), F.col("user"), F.col("assistant")).alias("text"))


def chatml_render(spark, sf_dir):
    return _blocks(spark, sf_dir).select("conv_id", F.md5("text").alias("md5"), F.length("text").alias("n_chars"))


def chatml_parse(spark, sf_dir):
    p = _blocks(spark, sf_dir).select("conv_id", chat.parse_by_role(F.col("text")).alias("p"))
    return p.select("conv_id", F.md5("p.user").alias("user_md5"), F.md5("p.assistant").alias("assistant_md5"))


def chatml_positions(spark, sf_dir):
    p = _blocks(spark, sf_dir).select("conv_id", chat.parse_by_position(F.col("text")).alias("p"))
    return p.select("conv_id", F.length("p.instruction").alias("n_instruction"), F.length("p.input").alias("n_input"), F.length("p.output").alias("n_output"))


def to_conversation(spark, sf_dir):
    p = _blocks(spark, sf_dir).select("conv_id", chat.conversation(chat.parse_by_role(F.col("text"))).alias("conversation")).where("conversation IS NOT NULL")
    n = numbered(p, ["conv_id"], "conversation_id", start=1)
    return n.select("conversation_id", F.lit("general").alias("category"), F.explode("conversation").alias("c")).select("conversation_id", "category", F.md5("c.human").alias("human_md5"), F.md5("c.assistant").alias("assistant_md5"))


def triplet_conversations(spark, sf_dir):
    """Records with both an input and an output, as conversations; empty parts count, missing ones don't."""
    p = _pairs(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, None).otherwise(F.col("human")).alias("input"), F.col("assistant").alias("output"))
    c = p.select("conv_id", "turn", chat.conversation(chat.triplet(F.col("input"), F.col("output"))).alias("c")).where("c IS NOT NULL")
    return c.select("conv_id", "turn", F.length(F.col("c")[0]["human"]).alias("n_human"), F.length(F.col("c")[0]["assistant"]).alias("n_assistant"))


def _whole(spark, sf_dir) -> DataFrame:
    """(conv_id, turns): pairs in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "human", "assistant")))
    return _pairs(spark, sf_dir).groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["human"].alias("human"), t["assistant"].alias("assistant"))).alias("turns"))


def template_render(spark, sf_dir):
    """Every conversation in every registered template."""
    c = _whole(spark, sf_dir).crossJoin(F.broadcast(chat.templates(spark)))
    return c.select("conv_id", "template_name", F.md5(chat.render(F.col("turns"), F.col("default_system"))).alias("md5"), F.size("turns").alias("rounds"))


def server_prompts(spark, sf_dir):
    w = _turns(spark, sf_dir).where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    w = w.withColumn("m", F.concat("m", F.array(F.struct(F.lit(10**6).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit("").alias("text")))))
    one = lambda style: F.md5(chat.prompt(F.lit("Be brief."), F.col("m"), style)).alias(style)
    return w.select("conv_id", *[one(s) for s in chat.STYLES], F.md5(chat.prompt(F.lit("Be brief."), F.col("m"), "colon", " ", "</s>")).alias("two_seps"))


def openai_messages(spark, sf_dir):
    w = _turns(spark, sf_dir).where("role <> 'system'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    m = w.select("conv_id", F.posexplode(chat.openai_messages(F.lit("Be brief."), F.col("t"))).alias("place", "m"))
    return m.select("conv_id", "place", "m.role", F.md5("m.content").alias("md5"))


def cumulative_history(spark, sf_dir):
    """Each prompt with all that was said before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(F.array_join(F.collect_list("text").over(w), "")).alias("md5"))


def shared_prefixes(spark, sf_dir):
    """Groups of prompts with a common system part stamped with the group's number."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    groups = spark.range(4).select(F.col("id").alias("g"), F.overlay(F.lit("shared instruction for all requests"), F.col("id").cast("string"), F.lit(1)).alias("system"))
    return b.crossJoin(F.broadcast(groups)).select("g", "item_id", F.md5(F.concat("system", F.lit("\n\n"), "text")).alias("md5"))


def few_shot(spark, sf_dir):
    """Three exemplars with answers before each question; and as many as a budget of words lets through."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("q"), F.substring_index("text", " ", -1).alias("a"))
    shots = prompts.exemplars(b.where("item_id < 3"), "item_id", prompts.question_answer(F.col("q"), F.col("a")))
    capped = prompts.within_budget(b.where("item_id < 12"), "item_id", prompts.question_answer(F.col("q"), F.col("a")), 400)
    out = b.crossJoin(F.broadcast(shots)).crossJoin(F.broadcast(capped.withColumnRenamed("shots", "capped")))
    return out.select("item_id", F.md5(F.concat("shots", F.lit("Question: "), "q", F.lit("\nAnswer:"))).alias("md5"), F.md5(F.concat("capped", "q")).alias("capped_md5"))


def choice_prompts(spark, sf_dir):
    """A question with lettered options, the permuted options, and the letter the gold option gets."""
    o = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", prompts.quarters(F.split("text", " ")).alias("options"))
    o = o.withColumn("shuffled", prompts.permuted(F.col("options"), F.col("item_id")))
    gold = F.element_at(F.split(F.lit("A B C D"), " "), F.array_position(F.transform("shuffled", lambda x: x["i"]), 0).cast("int"))
    return o.select("item_id", F.md5(prompts.lettered(F.col("options"))).alias("md5"), F.md5(prompts.bracketed(F.transform("shuffled", lambda x: x["o"]))).alias("shuffled_md5"), gold.alias("gold"))


def replicated(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")
    return b.select("item_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("try"))


def quartered(spark, sf_dir):
    """Each document's lines in four blocks."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("l"))
    return d.select("doc_id", F.posexplode(prompts.quarters(F.col("l"))).alias("part", "body")).select("doc_id", "part", F.md5("body").alias("md5"))


def query_items(spark, sf_dir):
    """Query and item joined in either order."""
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "turn", F.explode(F.array(F.lit(True), F.lit(False))).alias("query_first"), "human", "assistant").select("conv_id", "turn", "query_first", F.md5(F.when(F.col("query_first"), F.concat("human", "assistant")).otherwise(F.concat("assistant", "human"))).alias("md5"))


def even_conversations(spark, sf_dir):
    """Conversations of even length that a user opens, and the first two turns of those with two or more."""
    c = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    ok = (F.size("m") % 2 == 0) & (F.col("m")[0]["role"] == "user")
    return c.where(F.size("m") >= 2).select("conv_id", ok.alias("even"), F.length(F.col("m")[0]["text"]).alias("n_first"), F.length(F.col("m")[1]["text"]).alias("n_second"), F.size(F.filter("m", lambda t: F.length(t["text"]) < 400)).alias("n_short"))


QUERIES = {f.__name__: f for f in (chatml_render, chatml_parse, chatml_positions, to_conversation, triplet_conversations, template_render, server_prompts, openai_messages, cumulative_history, shared_prefixes, few_shot, choice_prompts, replicated, quartered, query_items, even_conversations)}


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_S = r"regexp_replace({c}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_strip = lambda c: _S.format(c=c)
_PAIRS = """(SELECT conv_id, turn, text AS human, nt AS assistant FROM (
    SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""
_FIRSTS = "(SELECT conv_id, " + ", ".join(f"coalesce(arg_min(text, turn) FILTER (role = '{r}'), '') AS {r}" for r in chat.ROLES) + " FROM conversations GROUP BY conv_id)"
_BLOCK = "concat(" + ", chr(10), ".join(f"'{chat.BEGIN}{chat.ROLES[r]}', chr(10), {_strip(r)}, chr(10), '{chat.END}'" for r in chat.ROLES) + ")"
_SPEAKERS = f"(SELECT conv_id, coalesce(nullif({_strip('user')}, ''), nullif({_strip('system')}, '')) AS u, nullif({_strip('assistant')}, '') AS a FROM {_FIRSTS})"
_TEMPLATES = "(VALUES " + ", ".join("(" + ", ".join(_q(x) for x in t) + ")" for t in chat.TEMPLATES) + ") t(template_name, sf, uf, af, ds, sw)"
_SQ = r"trim(regexp_replace(translate({c}, chr(8203) || chr(160), '  '), '[\s\x0b\x1c-\x1f\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), ' ')"


def _style_sql(style: str, sep: str = "chr(10)", sep2: str | None = None) -> str:
    opening, end, empty = chat.STYLES[style]
    text = _strip("text") if style.endswith("header") else "text"
    close = (sep if sep2 is None else f"CASE WHEN i % 2 = 0 THEN {sep} ELSE {sep2} END") if end == "{sep}" else _q(end)
    said = f"CASE WHEN length(text) > 0 THEN concat(replace({_q(opening)}, '{{role}}', role), {text}, {close}) ELSE replace({_q(empty)}, '{{role}}', role) END"
    lead = "'Be brief.'" if style in ("no_colon", "header", "short_header") else f"concat('Be brief.', {sep})"
    return f"md5(concat({lead}, string_agg({said}, '' ORDER BY i)))"


ORACLES = {
    "chatml_render": f"SELECT conv_id, md5(t) AS md5, length(t)::INTEGER AS n_chars FROM (SELECT conv_id, {_BLOCK} AS t FROM {_FIRSTS})",
    "chatml_parse": f"SELECT conv_id, CASE WHEN u IS NOT NULL AND a IS NOT NULL THEN md5(u) END AS user_md5, CASE WHEN u IS NOT NULL AND a IS NOT NULL THEN md5(a) END AS assistant_md5 FROM {_SPEAKERS}",
    "chatml_positions": f"SELECT conv_id, length({_SQ.format(c='system')})::INTEGER AS n_instruction, length({_SQ.format(c='user')})::INTEGER AS n_input, length({_SQ.format(c='assistant')})::INTEGER AS n_output FROM {_FIRSTS}",
    "to_conversation": f"SELECT row_number() OVER (ORDER BY conv_id) AS conversation_id, 'general' AS category, md5(u) AS human_md5, md5(a) AS assistant_md5 FROM {_SPEAKERS} WHERE u IS NOT NULL AND a IS NOT NULL",
    "triplet_conversations": f"SELECT conv_id, turn, length(human)::INTEGER AS n_human, length(assistant)::INTEGER AS n_assistant FROM {_PAIRS} WHERE turn % 3 <> 0",
    "template_render": f"""
        SELECT conv_id, template_name, md5(concat(CASE WHEN sf IS NOT NULL AND ds IS NOT NULL THEN replace(sf, '{{content}}', ds) ELSE '' END,
            string_agg(concat(replace(replace(replace(uf, '{{idx}}', i::VARCHAR), '{{stop_token}}', '</s>'), '{{content}}', {_strip("human")}),
                              replace(replace(af, '{{stop_token}}', '</s>'), '{{content}}', {_strip("assistant")})), '' ORDER BY i))) AS md5, count(*)::INTEGER AS rounds
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM {_PAIRS}), {_TEMPLATES}
        GROUP BY conv_id, template_name, sf, ds""",
    "server_prompts": f"""
        SELECT conv_id, {", ".join(f"{_style_sql(s)} AS {s}" for s in chat.STYLES)}, {_style_sql("colon", "' '", "'</s>'")} AS two_seps
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM (
            SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'
            UNION ALL SELECT DISTINCT conv_id, 1000000, 'assistant', '' FROM conversations WHERE role <> 'system')) GROUP BY conv_id""",
    "openai_messages": """
        SELECT conv_id, 0 AS place, 'system' AS role, md5('Be brief.') AS md5 FROM conversations WHERE role <> 'system' GROUP BY conv_id
        UNION ALL SELECT conv_id, k::INTEGER, CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END, md5(text)
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'system')""",
    "cumulative_history": "SELECT conv_id, turn, md5(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS md5 FROM conversations",
    "shared_prefixes": "SELECT g, item_id, md5(g::VARCHAR || substr('shared instruction for all requests', 2) || chr(10) || chr(10) || text) AS md5 FROM benchmark, range(4) r(g)",
    "few_shot": """
        WITH b AS (SELECT item_id, text AS q, string_split(text, ' ')[-1] AS a FROM benchmark),
        e AS (SELECT item_id, 'Question: ' || q || chr(10) || 'Answer: ' || a || chr(10) || chr(10) AS s FROM b),
        s AS (SELECT string_agg(s, '' ORDER BY item_id) AS shots FROM e WHERE item_id < 3),
        c AS (SELECT coalesce(string_agg(s, '' ORDER BY item_id), '') AS capped FROM (
            SELECT *, sum(len(regexp_extract_all(s, '[^ \\n]+'))) OVER (ORDER BY item_id) AS used FROM e WHERE item_id < 12) WHERE used <= 400)
        SELECT item_id, md5(shots || 'Question: ' || q || chr(10) || 'Answer:') AS md5, md5(capped || q) AS capped_md5 FROM b, s, c""",
    "choice_prompts": """
        WITH w AS (SELECT item_id, string_split(text, ' ') AS w, len(string_split(text, ' ')) // 4 AS k FROM benchmark),
        o AS (SELECT item_id, [array_to_string(w[1:k], chr(10)), array_to_string(w[k + 1:2 * k], chr(10)), array_to_string(w[2 * k + 1:3 * k], chr(10)), array_to_string(w[3 * k + 1:], chr(10))] AS o FROM w),
        x AS (SELECT item_id, i, o[i + 1] AS w, row_number() OVER (PARTITION BY item_id ORDER BY md5(item_id::VARCHAR || ':' || i::VARCHAR)) AS p FROM o, range(4) r(i))
        SELECT item_id, md5(string_agg(chr(65 + i::INTEGER) || '. ' || w, chr(10) ORDER BY i) || chr(10) || 'Answer:') AS md5,
               md5(string_agg('(' || chr(64 + p::INTEGER) || ') ' || w || chr(10), '' ORDER BY p)) AS shuffled_md5, max(CASE WHEN i = 0 THEN chr(64 + p::INTEGER) END) AS gold
        FROM x GROUP BY item_id""",
    "replicated": "SELECT item_id, t::INTEGER AS try FROM benchmark, range(1, 5) r(t)",
    "quartered": """
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, l, len(l) // 4 AS k, i FROM l, range(4) r(i))
        SELECT doc_id, i::INTEGER AS part, md5(array_to_string(CASE WHEN i = 3 THEN l[3 * k + 1:] ELSE l[i * k + 1:(i + 1) * k] END, chr(10))) AS md5 FROM p""",
    "query_items": f"SELECT conv_id, turn, f AS query_first, md5(CASE WHEN f THEN human || assistant ELSE assistant || human END) AS md5 FROM {_PAIRS}, (VALUES (true), (false)) v(f)",
    "even_conversations": """
        SELECT conv_id, count(*) % 2 = 0 AND arg_min(role, turn) = 'user' AS even, length(arg_min(text, turn))::INTEGER AS n_first,
               length(list(text ORDER BY turn)[2])::INTEGER AS n_second, (count(*) FILTER (length(text) < 400))::INTEGER AS n_short
        FROM conversations GROUP BY conv_id HAVING count(*) >= 2""",
}
