"""Queries over `documents`: quality filters, exact and near duplicates, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import dedup, mix, quality
from tessera.operators.shared import checkpointed


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_scalars(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("norm", tx.squeeze(F.col("text")))
    return d.select(
        "doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").alias("norm_len"), F.round(tx.script_ratio(F.col("norm"), "latin"), 6).alias("latin_ratio"),
        F.round(tx.script_ratio(F.col("text")), 6).alias("han_ratio"), tx.url_count(F.col("text")).alias("n_urls"), tx.has_pii(F.col("norm")).alias("has_pii"),
        tx.length_ok(F.col("norm"), 100, 20000).alias("length_ok"), tx.matches_any(F.col("norm")).alias("refuses"),
    )


def normalize_nfkc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("norm_md5"))


def fingerprints(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.fingerprint(F.col("text")).alias("fp"), F.md5("text").alias("md5"))


def quality_filter(spark, sf_dir):
    d = quality.judged(_docs(spark, sf_dir), output="text", script="latin", least_ratio=0.6, lengths=((0, 10**9), (0, 10**9), (100, 20000)))
    return d.where("reject_reason IS NULL").select("doc_id", "source", F.md5(F.col("out_norm")).alias("fp"))


def reject_reasons(spark, sf_dir):
    d = quality.judged(_docs(spark, sf_dir), output="text", script="latin", least_ratio=0.6, lengths=((0, 10**9), (0, 10**9), (100, 20000)))
    return d.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def scan_counters(spark, sf_dir):
    d = quality.judged(_docs(spark, sf_dir), output="text", script="latin", least_ratio=0.6, lengths=((0, 10**9), (0, 10**9), (100, 20000)))
    d = d.withColumn("ok", F.col("reject_reason").isNull()).withColumn("fp", F.md5("out_norm"))
    w = Window.partitionBy("fp", "ok").orderBy("doc_id")
    d = d.withColumn("rn", F.row_number().over(w))
    return d.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("filtered"), F.count_if(F.col("ok") & (F.col("rn") > 1)).alias("duplicates"), F.count_if(F.col("ok") & (F.col("rn") == 1)).alias("kept")
    )


def exact_dedup_first_wins(spark, sf_dir):
    """The first document of each text, in doc_id order."""
    d = _docs(spark, sf_dir).select("doc_id", "source", F.md5("text").alias("fp"))
    return dedup.first_wins(d, F.col("fp"), "doc_id")


def dedup_precedence(spark, sf_dir):
    """Sources in a fixed order of precedence: an earlier source's text wins over a later one's."""
    d = _docs(spark, sf_dir).select("doc_id", "source", F.md5("text").alias("fp"), F.when(F.col("source") == "src9", 0).when(F.col("source") == "src3", 1).otherwise(2).alias("source_rank"))
    return dedup.first_wins(d, F.col("fp"), "source_rank", "doc_id").groupBy("source_rank").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def anti_join_seen(spark, sf_dir):
    """Documents whose text isn't that of a labelled document or a benchmark item."""
    d = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("fp"))
    labelled = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    seen = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.md5("text").alias("fp")).union(labelled.select("fp"))
    return dedup.unseen(d, seen, "fp").select("doc_id", "fp")


def first_n_in_order(spark, sf_dir):
    """What a cap on kept rows leaves: the first 100 after the filter and exact dedup, by source."""
    d = dedup.first_wins(_docs(spark, sf_dir).where(tx.length_ok(F.col("text"), 100, 20000)).select("doc_id", "source", F.md5("text").alias("fp")), F.col("fp"), "doc_id")
    return d.orderBy("doc_id").limit(100).select("doc_id", "source")


def contiguous_ids(spark, sf_dir):
    from tessera.operators.sequence import numbered

    d = dedup.first_wins(_docs(spark, sf_dir).select("doc_id", F.md5("text").alias("fp")), F.col("fp"), "doc_id")
    return numbered(d, ["doc_id"], "conversation_id", start=1).select("doc_id", "conversation_id")


def simhash_signatures(spark, sf_dir):
    return dedup.simhash(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "sig")


def _unique(spark, sf_dir):
    return dedup.first_wins(_docs(spark, sf_dir).withColumn("fp", F.md5("text")), F.col("fp"), "doc_id")


def _unique_signatures(spark, sf_dir):
    """(doc_id, sig) of the first document of each text, computed once; texts aren't shuffled."""
    sigs = dedup.simhash(_docs(spark, sf_dir).withColumn("fp", F.md5("text")), "doc_id", "text", ("fp",))
    return checkpointed(dedup.first_wins(sigs, F.col("fp"), "doc_id").select("doc_id", "sig"))


def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(_unique_signatures(spark, sf_dir))


def near_dup_survivors(spark, sf_dir):
    return dedup.near_survivors(_unique_signatures(spark, sf_dir))


def _sizes(d: DataFrame) -> dict[str, int]:
    return {r["source"]: r["n"] for r in mix.summary(d, "source").collect()}


def quota_mix(spark, sf_dir):
    d = _unique(spark, sf_dir).select("doc_id", "fp", F.when(F.col("source") == "src0", "domain").otherwise("general").alias("source"))
    quota = mix.allocate(dict(sorted(_sizes(d).items())), {"domain": 0.4, "general": 0.6}, 400)
    return mix.sample(d, quota, "source", F.col("fp")).select("doc_id", "source", "fp")


def mix_fill(spark, sf_dir):
    d = _unique(spark, sf_dir).select("doc_id", "fp", F.when(F.col("source") == "src0", "domain").otherwise("general").alias("source"))
    picked = mix.sample(d, {"domain": 20, "general": 100}, "source", F.col("fp"))
    return mix.fill(picked, d, "fp", 200).select("doc_id", "source")


def dataset_info(spark, sf_dir):
    d = _unique(spark, sf_dir)
    return d.agg(
        F.count("*").alias("final_count"), F.count_if(F.col("source") == "src0").alias("domain_kept"), F.count_if(F.col("source") != "src0").alias("general_kept"),
        F.lit(0.4).alias("ratio_target"), F.lit(3).alias("near_dup_threshold_bits"),
    )


def seeded_shuffle(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", mix.draw(F.col("doc_id"), 42).alias("place"))
    from tessera.operators.sequence import numbered

    return numbered(d, ["place", "doc_id"], "position", start=0).select("doc_id", "position")


def page_text(spark, sf_dir):
    """Pages without scripts, styles, comments and tags, normalised; how many links each has."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), "<[^>]*>", " ")
    return p.select("page_id", F.md5(tx.squeeze(bare)).alias("text_md5"), F.regexp_count("html", F.lit(r"<a href=")).cast("long").alias("n_links"), tx.url_count(F.col("url")).cast("long").alias("n_urls"))


def json_repair(spark, sf_dir):
    """Event properties with a control character put in, repaired and parsed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.substring("props", 1, 1), F.lit("\x01"), F.substring("props", F.lit(2), F.length("props"))).alias("raw"))
    return e.select("event_id", F.get_json_object(tx.repaired_json(F.col("raw")), "$.k").cast("long").alias("k"))


QUERIES = {f.__name__: f for f in (text_scalars, normalize_nfkc, fingerprints, quality_filter, reject_reasons, scan_counters, exact_dedup_first_wins, dedup_precedence, anti_join_seen, first_n_in_order, contiguous_ids, simhash_signatures, near_dup_pairs, near_dup_survivors, quota_mix, mix_fill, dataset_info, seeded_shuffle, page_text, json_repair)}

_SQUEEZE = r"trim(regexp_replace(translate({c}, chr(8203) || chr(160), '  '), '[\s\x0b\x1c-\x1f\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), ' ')"
_PII = r"regexp_matches({c}, '(^|[^\p{{L}}\p{{N}}_])1[3-9][0-9]{{9}}($|[^\p{{L}}\p{{N}}_])|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}|(^|[^\p{{L}}\p{{N}}_])([0-9]{{17}}[0-9Xx]|[0-9]{{15}}($|[^\p{{L}}\p{{N}}_]))')"
_REFUSE = "(" + " OR ".join("regexp_matches({c}, '" + p.replace("'", "''") + "')" for p in tx.REFUSALS) + ")"
_RATIO = "(length(regexp_replace({c}, '[^A-Za-zÀ-ɏ]', '', 'g')) / greatest(1, length({c}))::DOUBLE)"
_JUDGED = f"""(
    SELECT *, CASE WHEN length(o) = 0 THEN 'empty'
                   WHEN {_RATIO.format(c="o")} < 0.6 THEN 'ratio'
                   WHEN length(o) NOT BETWEEN 100 AND 20000 THEN 'length'
                   WHEN {_REFUSE.replace("{c}", "o")} THEN 'pattern'
                   WHEN len(regexp_extract_all(o, 'https?://\\S+')) > 5 THEN 'urls'
                   WHEN {_PII.format(c="o")} THEN 'pii' END AS reject_reason
    FROM (SELECT *, {_SQUEEZE.format(c="text")} AS o FROM documents))"""
_SIG = r"""
    SELECT doc_id, (sum(CASE WHEN v >= 0 THEN 1::HUGEINT << i ELSE 0 END)
                    - CASE WHEN max(CASE WHEN i = 63 AND v >= 0 THEN 1 ELSE 0 END) = 1 THEN 1::HUGEINT << 64 ELSE 0 END)::BIGINT AS sig
    FROM (SELECT doc_id, i, sum(CASE WHEN h IS NULL THEN 0 WHEN (h >> i::UBIGINT) & 1 = 1 THEN 1 ELSE -1 END) AS v
          FROM (SELECT doc_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h
                FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w
                      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM %s))), range(64) r(i)
          GROUP BY doc_id, i) GROUP BY doc_id"""
_UNIQUE = "(SELECT *, md5(text) AS fp FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1)"

ORACLES = {
    "text_scalars": f"""
        SELECT doc_id, md5(o) AS norm_md5, length(o)::INTEGER AS norm_len, round({_RATIO.format(c="o")}, 6) AS latin_ratio,
               round(length(regexp_replace(text, '[^一-鿿㐀-䶿]', '', 'g')) / greatest(1, length(text))::DOUBLE, 6) AS han_ratio,
               len(regexp_extract_all(text, 'https?://\\S+'))::INTEGER AS n_urls, {_PII.format(c="o")} AS has_pii,
               length(o) BETWEEN 100 AND 20000 AS length_ok, {_REFUSE.replace("{c}", "o")} AS refuses
        FROM (SELECT *, {_SQUEEZE.format(c="text")} AS o FROM documents)""",
    "fingerprints": "SELECT doc_id, substr(md5(to_json(text)::VARCHAR), 1, 16) AS fp, md5(text) AS md5 FROM documents",
    "quality_filter": f"SELECT doc_id, source, md5(o) AS fp FROM {_JUDGED} WHERE reject_reason IS NULL",
    "reject_reasons": f"SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM {_JUDGED} GROUP BY 1",
    "scan_counters": f"""
        SELECT source, count(*) AS total, count(*) FILTER (reject_reason IS NOT NULL) AS filtered,
               count(*) FILTER (reject_reason IS NULL AND rn > 1) AS duplicates, count(*) FILTER (reject_reason IS NULL AND rn = 1) AS kept
        FROM (SELECT *, row_number() OVER (PARTITION BY md5(o), reject_reason IS NULL ORDER BY doc_id) AS rn FROM {_JUDGED}) GROUP BY source""",
    "exact_dedup_first_wins": "SELECT doc_id, source, md5(text) AS fp FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
    "dedup_precedence": """
        SELECT source_rank, count(*) AS n, min(doc_id) AS first_id FROM (
            SELECT *, CASE source WHEN 'src9' THEN 0 WHEN 'src3' THEN 1 ELSE 2 END AS source_rank FROM documents
            QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source_rank, doc_id) = 1) GROUP BY 1""",
    "anti_join_seen": """
        SELECT doc_id, md5(text) AS fp FROM documents
        WHERE md5(text) NOT IN (SELECT md5(text) FROM benchmark UNION ALL SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
    "first_n_in_order": """
        SELECT doc_id, source FROM (SELECT * FROM documents WHERE length(text) BETWEEN 100 AND 20000
            QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1) ORDER BY doc_id LIMIT 100""",
    "contiguous_ids": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS conversation_id FROM {_UNIQUE}",
    "simhash_signatures": _SIG % "documents",
    "near_dup_pairs": f"""
        WITH s AS ({_SIG % _UNIQUE}), k AS (SELECT doc_id, sig, b, (sig >> (16 * b)) & 65535 AS v FROM s, range(4) r(b))
        SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.b = y.b AND x.v = y.v AND x.doc_id < y.doc_id
        WHERE bit_count(xor(x.sig, y.sig)) <= 3""",
    "quota_mix": f"""
        WITH d AS (SELECT doc_id, fp, CASE WHEN source = 'src0' THEN 'domain' ELSE 'general' END AS source FROM {_UNIQUE}),
        n AS (SELECT count(*) FILTER (source = 'domain') AS nd, count(*) FILTER (source = 'general') AS ng FROM d),
        q AS (SELECT least(nd, 160) AS qd, least(ng, 240) AS qg, nd, ng FROM n),
        f AS (SELECT qd + least(nd - qd, CASE WHEN ng = qg THEN 400 - qd - qg ELSE ceil((400 - qd - qg) / 2.0) END) AS fd, qd, qg, nd, ng FROM q),
        g AS (SELECT fd, least(ng, 400 - fd) AS fg FROM f)
        SELECT doc_id, source, fp FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || fp), fp) AS rn FROM d), g
        WHERE rn <= CASE source WHEN 'domain' THEN fd ELSE fg END""",
    "mix_fill": f"""
        WITH d AS (SELECT doc_id, fp, CASE WHEN source = 'src0' THEN 'domain' ELSE 'general' END AS source FROM {_UNIQUE}),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || fp), fp) AS rn FROM d),
        p AS (SELECT * FROM r WHERE rn <= CASE source WHEN 'domain' THEN 20 ELSE 100 END)
        SELECT doc_id, source FROM p UNION ALL
        SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY md5('42|' || fp), fp) AS k FROM d WHERE fp NOT IN (SELECT fp FROM p))
        WHERE k <= greatest(0, 200 - (SELECT count(*) FROM p))""",
    "dataset_info": f"""
        SELECT count(*) AS final_count, count(*) FILTER (source = 'src0') AS domain_kept, count(*) FILTER (source <> 'src0') AS general_kept,
               0.4::DOUBLE AS ratio_target, 3 AS near_dup_threshold_bits FROM {_UNIQUE}""",
    "seeded_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) - 1 AS position FROM documents",
    "page_text": f"""
        SELECT page_id, md5({_SQUEEZE.format(c="regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")}) AS text_md5,
               len(regexp_extract_all(html, '<a href=')) AS n_links, len(regexp_extract_all(url, 'https?://\\S+')) AS n_urls FROM pages""",
    "json_repair": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
}
