"""Queries on article rows made of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import articles, corpus, findings
from ..session import spread, table
from ..sources import files, html, site_files
from . import sql as S
from .catalog import _LINKS, page_rows, query, turn_pairs

def page_articles(spark: SparkSession, d: str) -> DataFrame:
    """Article rows of the pages: title, description, slug and blocks (headings of the first level left out)."""
    pages = spread(table(spark, d, "pages"))
    rows = html.page_rows(pages, only=["title", "description", "schema_types"]).select("page_id", "title", F.col("description").alias("meta_description"), html.slug(F.col("url")).alias("slug"), "schema_types")
    found = html.block_rows(pages, "page_id").filter("type != 'h1'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "text"))).alias("_b"))
    none = F.array().cast("array<struct<type:string,text:string>>")
    rows = rows.join(found, "page_id", "left").withColumn("blocks", F.coalesce(F.transform("_b", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"))), none))
    return rows.withColumn("faqs", F.array().cast("array<struct<q:string,a:string>>")).drop("_b")


_TERMS = f"list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({S.names(L.AUDIT_STOP)}, w))"
_BLOCKS = f"""a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '{S.NOISE}', '', 'g'), '{S.FURNITURE}', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, list_filter(string_split(regexp_replace(h, '(?i)<(h[1-4]|p|li|blockquote|pre)(?:[ \\t\\n][^>]*)?>', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda x: contains(x, chr(2))) AS parts FROM a),
c AS (SELECT page_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM b),
e AS (SELECT page_id, i, lower(string_split(x, chr(2))[1]) AS k, {S.plain("regexp_extract(x, '(?is)' || chr(2) || '(.*?)(</(h[1-4]|p|li|blockquote|pre)>|$)', 1)")} AS text FROM c),
f AS (SELECT page_id, i, k, text FROM e WHERE length(text) >= 2), g AS (SELECT *, lag(k) OVER w AS lk, lag(text) OVER w AS lx FROM f WINDOW w AS (PARTITION BY page_id ORDER BY i)),
body AS (SELECT page_id, lower(string_agg(text, chr(10) || chr(10) ORDER BY i)) AS body FROM g WHERE NOT (lk IS NOT DISTINCT FROM k AND lx IS NOT DISTINCT FROM text) AND k <> 'h1' GROUP BY page_id)"""
_COUNT = "(length(body) - length(replace(body, {0}, ''))) // length({0})"


@query(
    f"""{S.pages()}, {_BLOCKS}, t AS (SELECT p.page_id, {_TERMS} AS ts, coalesce(body, '') AS body FROM p LEFT JOIN body USING (page_id)),
n AS (SELECT page_id, ts, body, list_filter(list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2]), lambda q: {_COUNT.format("q")} >= 2) AS tri,
    list_filter(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]), lambda q: {_COUNT.format("q")} >= 2) AS bi, list_transform(ts, lambda w: {_COUNT.format("w")}) AS cs FROM t)
SELECT page_id, coalesce(tri[1], bi[1], CASE WHEN len(ts) > 0 THEN ts[list_position(cs, list_max(cs))] END, '') AS keyword FROM n"""
)
def c15_keyword(spark, d):
    return articles.keyword(page_articles(spark, d)).select("page_id", "keyword")


@query(
    f"""{S.pages()}, {_LINKS}, t AS (SELECT rtrim(url, '/') AS url, {S.token_set("title", L.SITE_STOP)} AS s FROM p), c AS (SELECT * FROM t ORDER BY url LIMIT 40),
m AS (SELECT c.url AS target, t.url AS source, len(list_intersect(c.s, t.s))::BIGINT AS shared, len(list_intersect(c.s, t.s)) / len(c.s) AS score FROM c, t WHERE len(c.s) >= 2 AND c.url <> t.url AND len(list_intersect(c.s, t.s)) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS k FROM m WHERE score >= 0.4 AND NOT EXISTS (SELECT 1 FROM l1 WHERE rtrim(l1.url, '/') = m.source AND l1.target = m.target)),
n AS (SELECT *, max(k) OVER (PARTITION BY target) AS n FROM k WHERE k <= 5), top AS (SELECT DISTINCT target, n FROM n ORDER BY n DESC, target LIMIT 30)
SELECT n.target, source, shared, round(score, 2) AS score, k::BIGINT AS k FROM n JOIN top USING (target)"""
)
def g3_link_suggestions(spark, d):
    """No page of the tables links to another, so that the targets are the first ones by address."""
    rows = page_rows(spark, d, "title", "links")
    links = corpus.link_rows(rows)
    found = articles.link_suggestions(rows, links.select("url", "target"), corpus.in_degree(links, rows))
    return found.select("target", "source", "shared", "score", F.col("k").cast("long").alias("k"))


_KEYWORD_SQL = f"""{S.pages()}, {_BLOCKS}, t AS (SELECT p.page_id, url, {_TERMS} AS ts, coalesce(body, '') AS body FROM p LEFT JOIN body USING (page_id)),
n AS (SELECT page_id, url, ts, body, list_filter(list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2]), lambda q: {_COUNT.format("q")} >= 2) AS tri,
    list_filter(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]), lambda q: {_COUNT.format("q")} >= 2) AS bi, list_transform(ts, lambda w: {_COUNT.format("w")}) AS cs FROM t),
kw AS (SELECT page_id, url, body, coalesce(tri[1], bi[1], CASE WHEN len(ts) > 0 THEN ts[list_position(cs, list_max(cs))] END, '') AS keyword FROM n)"""


@query(
    f"""{_KEYWORD_SQL}, k1 AS (SELECT page_id, keyword, body, regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1) AS slug,
CASE WHEN keyword <> '' THEN round(((length(body) - length(replace(body, keyword, ''))) / greatest(length(keyword), 1)) / greatest(1, {S.wc("body")}) * 100.0::DOUBLE, 2) END AS density FROM kw)
SELECT page_id, 'keywords' AS "group", 'detected' AS "check", 'warn' AS status, 'medium' AS impact FROM k1 WHERE keyword = ''
UNION ALL SELECT page_id, 'keywords', 'density', CASE WHEN density = 0 OR density > 3.0 THEN 'fail' WHEN density > 2.0 OR density < 0.3 THEN 'warn' ELSE 'pass' END, CASE WHEN density = 0 OR density > 3.0 THEN 'high' WHEN density > 2.0 THEN 'medium' WHEN density < 0.3 THEN 'low' ELSE 'medium' END FROM k1 WHERE keyword <> ''
UNION ALL SELECT page_id, 'keywords', 'first_paragraph', CASE WHEN contains(array_to_string({S.toks("body")}[1:100], ' '), keyword) THEN 'pass' ELSE 'warn' END, 'medium' FROM k1 WHERE keyword <> ''
UNION ALL SELECT page_id, 'keywords', 'url', 'warn', 'medium' FROM k1 WHERE keyword <> '' AND slug <> '' AND NOT contains(lower(slug), replace(keyword, ' ', '-'))"""
)
def e20_keyword_findings(spark, d):
    rows = articles.keyword(page_articles(spark, d).withColumn("body", articles.body_text()))
    return findings.keyword_placement(rows, "page_id")


@query(
    f"""{S.pages()}, s0 AS (SELECT *, string_split(trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), '/')[1] AS g FROM p), s AS (SELECT *, CASE WHEN g = '' THEN 'Pages' ELSE upper(left(g, 1)) || lower(substr(g, 2)) END AS section FROM s0),
k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY words DESC, url) AS k FROM s)
SELECT section, count(*)::BIGINT AS n, string_agg('- [' || CASE WHEN trim(title, ' ') = '' THEN url ELSE trim(title, ' ') END || '](' || url || ')', chr(10) ORDER BY k) FILTER (k <= 40) AS text FROM k GROUP BY section"""
)
def e31_llms_txt(spark, d):
    """The site's sections with their forty longest pages each."""
    return site_files.llms_txt(html.page_rows(spread(table(spark, d, "pages"))))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200")
def j5_latest(spark, d):
    """The ledger's view of the latest 200 lines."""
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "user_id", "event_type")


@query(
    f"""WITH pairs AS (SELECT a.conv_id, a.turn, {S.token_set("a.text", L.AUDIT_STOP)} AS s, {S.token_set("b.text", L.AUDIT_STOP)} AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1)
SELECT conv_id, turn, len(list_intersect(s, t))::BIGINT AS shared, len(list_filter(t, lambda w: NOT list_contains(s, w)))::BIGINT AS added, len(list_filter(s, lambda w: NOT list_contains(t, w)))::BIGINT AS gone FROM pairs"""
)
def k1_k2_set_differences(spark, d):
    rows = turn_pairs(spark, d).select("conv_id", "turn", T.token_set(F.col("before"), L.AUDIT_STOP).alias("s"), T.token_set(F.col("after"), L.AUDIT_STOP).alias("t"))
    return rows.select("conv_id", "turn", *(F.size(c).cast("long").alias(n) for n, c in (("shared", F.array_intersect("s", "t")), ("added", F.array_except("t", "s")), ("gone", F.array_except("s", "t")))))


@query(
    f"""{S.pages()}, fs AS (SELECT page_id, 'meta' AS "group", 'present' AS "check", 'fail' AS status, 'high' AS impact FROM p WHERE description = ''
UNION ALL SELECT page_id, 'headings', 'structure', 'fail', 'high' FROM p WHERE len(h2) = 0)
SELECT * FROM fs ORDER BY CASE "check" WHEN 'present' THEN 1 ELSE 2 END, page_id, "group", "check" LIMIT 20"""
)
def j2_first_actions(spark, d):
    """The twenty first things to do over all pages: with these tables, descriptions that are missing."""
    return files.prioritise(findings.page(html.page_rows(spread(table(spark, d, "pages")))), "page_id")
