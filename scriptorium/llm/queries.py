"""The thin queries over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogue, interactions, licenses, minhash, mixing, ngrams, packing, pagediff, radixdedup, simhash, sketch, urlrules, weaksup
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketch.edits(_table(spark, sf_dir, "documents"))
    a, b, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        sketch.text_form(a).alias("fingerprint"),
        sketch.text_form(b).alias("edited_fingerprint"),
        sketch.resemblance(a, b).alias("near_edited"),
        sketch.resemblance(a, after).alias("near_next"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaksup.score(_table(spark, sf_dir, "documents"), Scratch(spark, "quality"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"), urlrules.rule_table(spark, RULES))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.group(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngrams.fit_and_score(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radixdedup.report(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(_table(spark, sf_dir, "documents"))
    names = F.transform("matches", lambda m: m["licence"])
    return rows.select("doc_id", "n_sentences", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licences"), "matches")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = dialogue.repair(dialogue.damaged(rows))
    out = rows.select("conv_id").distinct()
    for part in (found.summary, dialogue.digests(found.rows)):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.fillna(0, list(counts)).select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near(_table(spark, sf_dir, "documents"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_fingerprints, op3_html_extraction, op4_quality_rules, op5_url_filters, op6_simhash, op7_packing, op8_lm_scoring, op9_radix_dedup, op10_license_scan,
        op11_filter_audit, op12_conversation_repair, op13_minhash,
    )
}

ORACLES = {
    "op5_url_filters": r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fits AS (SELECT u.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON f.n = u.n AND f.k = 1
""",
    # every order is walked step by step; the Shapley value is the sum of what a filter removes
    "op11_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
says AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
rows AS (SELECT d.part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false))::INT AS m
    FROM docs d LEFT JOIN says s ON s.doc_id = d.doc_id),
counts AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY 1, 2),
f(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT [a.l, b.l, c.l, d.l, e.l] AS ls, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT array_to_string(ls, '') AS filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
walked AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & before = 0 AND m & bit != 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & before != 0 AND m & bit != 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & before = 0 AND m & bit != 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & before = 0 AND m & bit != 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM walked
""",
    # row after row, with the least (cost, audit) of each state; the repaired text is carried along with its audit
    "op12_conversation_repair": r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS d FROM said),
dealt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE d != 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dealt),
faults AS (SELECT *, left(role, 1) AS r, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0 FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY 1),
dp AS (
    SELECT conv_id, n, 0::BIGINT AS i, 0 AS phase, [{'q': 0, 'c': 0, 'a': '', 't': []::VARCHAR[]}] AS v FROM counts
    UNION ALL
    SELECT x.conv_id, x.n, CASE WHEN x.phase = 2 THEN x.i + 1 ELSE x.i END, CASE WHEN x.phase = 2 THEN 0 ELSE x.phase + 1 END,
        list_transform(list_filter([0, 1, 2, 3], lambda q: len(list_filter(x.o, lambda e: e.q = q)) > 0), lambda q: list_min(list_transform(list_filter(x.o, lambda e: e.q = q), lambda e: {'c': e.c, 'a': e.a, 'q': e.q, 't': e.t})))
            .list_transform(lambda e: {'q': e.q, 'c': e.c, 'a': e.a, 't': e.t})
    FROM (SELECT p.conv_id, p.n, p.i, p.phase, CASE
            WHEN p.phase < 2 THEN list_concat(p.v, flatten(list_transform(p.v, lambda e: CASE WHEN e.q = 2 THEN [{'q': 3, 'c': e.c + 5, 'a': e.a || 'I', 't': list_append(e.t, 'assistant:')}] ELSE [{'q': 2, 'c': e.c + 5, 'a': e.a || 'I', 't': list_append(e.t, 'user:')}] END)))
            ELSE flatten(list_transform(p.v, lambda e: list_filter([
                {'q': e.q, 'c': e.c + 2, 'a': e.a || 'D', 't': e.t},
                {'q': CASE WHEN e.q = 2 THEN 3 ELSE 2 END, 'c': CASE WHEN f.fault IN ('blank', 'duplicate') THEN NULL ELSE e.c + 1 + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END END, 'a': e.a || 'R', 't': list_append(e.t, CASE WHEN e.q = 2 THEN 'assistant:' ELSE 'user:' END || f.text)},
                {'q': CASE f.r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'c': CASE WHEN f.fault IN ('blank', 'duplicate') OR NOT (f.r = 's' AND e.q = 0 OR f.r = 'u' AND e.q != 2 OR f.r = 'a' AND e.q = 2) THEN NULL ELSE e.c + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END END, 'a': e.a || 'K', 't': list_append(e.t, f.role || ':' || f.text)}
                ], lambda y: y.c IS NOT NULL))) END AS o
        FROM dp p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 WHERE p.phase < 2 OR p.i < p.n) x),
ends AS (SELECT conv_id, list_min(list_transform(list_filter(v, lambda e: e.q IN (0, 3)), lambda e: {'c': e.c, 'a': e.a, 't': e.t})) AS e FROM dp WHERE i = n AND phase = 2)
SELECT c.conv_id, coalesce(k.gaps, 0)::BIGINT AS gaps, coalesce(k.blank, 0)::BIGINT AS blank, coalesce(k.duplicate, 0)::BIGINT AS duplicate, coalesce(k.truncated, 0)::BIGINT AS truncated, coalesce(k.illegal, 0)::BIGINT AS illegal,
    coalesce(e.e.c, 0)::BIGINT AS cost, coalesce(e.e.a, '') AS audit, sha256(coalesce(array_to_string(e.e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    # all pairs that share a shingle, and the least id reachable
    "op13_minhash": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id != b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a AS root, b AS node FROM pairs UNION SELECT r.root, p.b FROM reach r JOIN pairs p ON p.a = r.node),
least_ids AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.root, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(r.root, s.doc_id)) AS kept FROM sets s LEFT JOIN least_ids r ON r.node = s.doc_id
""",
}
