"""A crawl of the pages table: addresses, answers, descriptions and canonical links follow from a page's id and its own links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, crawl
from ..sources import html
from . import sql as S
from .catalog import _LINKS, page_rows, query

_FIELDS = ("title", "h1", "words", "content_hash", "images_no_alt", "schema_types", "links")


def crawled(spark, d) -> DataFrame:
    """Every third page was redirected to the first page its own links name; some gave errors."""
    i = F.col("page_id")
    rows = page_rows(spark, d, *_FIELDS)
    first = F.get(F.filter("links", lambda x: F.startswith(x, F.lit("/"))), F.lit(0))
    final = F.when((i % 3 == 1) & first.isNotNull(), html.absolute(first, F.col("url"))).otherwise(F.lit(""))
    rows = rows.withColumns({"final_url": final, "status": F.when(i % 13 == 5, 404).otherwise(200), "error": F.when(i % 29 == 3, "timeout")})
    rows = rows.withColumns({"redirects": (F.col("final_url") != "").cast("int"), "description": F.when(i % 4 == 0, "").when(i % 4 == 1, F.col("title")).otherwise(F.concat_ws(" ", "title", "title", "title"))})
    rows = rows.withColumn("robots", F.when(i % 10 == 7, "noindex, follow").otherwise(F.lit("")))
    return rows.withColumn("canonical", F.when(i % 6 == 0, F.concat("url", F.lit("/"))).when(i % 6 == 1, F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1)).otherwise(F.lit("")))


def _links(pages: DataFrame) -> DataFrame:
    return corpus.link_rows(crawl.good(pages).select("url", "links"))


def _checked(links: DataFrame) -> DataFrame:
    """What requests for targets gave: by their lengths; not all were made."""
    n = F.length("target")
    return links.select("target").distinct().filter(n % 5 > 0).select("target", F.when(n % 5 == 1, 404).when(n % 5 == 2, None).otherwise(200).alias("status"))


_SHARED = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{severity}' AS severity, url, left(v, 90) AS value FROM (SELECT url, {v} AS v, count(*) OVER (PARTITION BY {v}) AS n FROM ok) WHERE n > 1 AND v <> ''"
    for kind, severity, v in (("duplicate_title", "fail", "lower(trim(title))"), ("duplicate_meta", "warn", "lower(trim(description))"), ("duplicate_content", "fail", "CASE WHEN words > 100 THEN content_hash END"))
)
_SINGLE = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{severity}' AS severity, url, coalesce(({value})::VARCHAR, '') AS value FROM {of} WHERE {when}"
    for kind, severity, when, value, of in (
        ("missing_title", "fail", "title = ''", "''", "ok"),
        ("title_length", "warn", "title <> '' AND NOT length(title) BETWEEN 30 AND 60", "length(title)", "ok"),
        ("missing_meta", "fail", "description = ''", "''", "ok"),
        ("meta_length", "warn", "description <> '' AND NOT length(description) BETWEEN {lo} AND {hi}", "length(description)", "ok"),
        ("thin", "warn", "words > 0 AND words < 300", "words", "ok"),
        ("no_h1", "warn", "len(h1) = 0", "''", "ok"),
        ("multi_h1", "warn", "len(h1) > 1", "len(h1)", "ok"),
        ("no_schema", "warn", "len(schema_types) = 0", "''", "ok"),
        ("images_no_alt", "warn", "no_alt > 0", "no_alt", "ok"),
        ("noindex", "fail", "robots LIKE '%noindex%'", "robots", "ok"),
        ("canonical_conflict", "fail", "canonical <> '' AND rtrim(canonical, '/') <> final", "canonical", "ok"),
        ("redirect", "warn", "final_url <> ''", "final_url", "ok"),
        ("error_status", "fail", "status >= 400 OR error IS NOT NULL", "coalesce(error, status::VARCHAR)", "cr"),
    )
)


def _sql() -> str:
    from ..functions import lexicons as L

    alt = S.attribute("i", "alt")
    base = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)"
    return f"""{S.pages()}, al AS (SELECT page_id AS alt_id, len(list_filter(imgs, lambda i: trim({alt}) = '')) AS no_alt FROM p1),
cr0 AS (SELECT * EXCLUDE (description), CASE WHEN page_id % 3 = 1 THEN coalesce({base} || regexp_replace(list_filter(links, lambda x: starts_with(x, '/'))[1], '#.*$', ''), '') ELSE '' END AS final_url, CASE WHEN page_id % 13 = 5 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 29 = 3 THEN 'timeout' END AS error,
    CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN title ELSE title || ' ' || title || ' ' || title END AS description, CASE WHEN page_id % 10 = 7 THEN 'noindex, follow' ELSE '' END AS robots, CASE page_id % 6 WHEN 0 THEN url || '/' WHEN 1 THEN {base} ELSE '' END AS canonical FROM p JOIN al ON alt_id = page_id),
cr AS (SELECT *, rtrim(CASE WHEN final_url <> '' THEN final_url ELSE url END, '/') AS final FROM cr0), ok AS (SELECT * FROM cr WHERE status = 200 AND error IS NULL),
{_LINKS.replace("FROM p)", "FROM ok)")}, li AS (SELECT * FROM l1 WHERE {S.host("url")} = {S.host("target")}), ib AS (SELECT target, count(*) AS n FROM li GROUP BY target),
un AS (SELECT target, min(url) AS url FROM li WHERE target NOT IN (SELECT final FROM ok) GROUP BY target),
iss AS ({_SINGLE.format(lo=L.DESCRIPTION_MIN, hi=L.DESCRIPTION_MAX)} UNION ALL {_SHARED}
UNION ALL SELECT 'broken_internal', 'fail', url, target FROM un WHERE length(target) % 5 IN (1, 2)
UNION ALL SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'orphan' ELSE 'few_inbound' END, CASE WHEN coalesce(n, 0) = 0 THEN 'fail' ELSE 'warn' END, url, coalesce(n, 0)::VARCHAR FROM ok LEFT JOIN ib ON target = final WHERE coalesce(n, 0) < 3)"""


_ISSUES = _sql()


@query(f"{_ISSUES} SELECT kind, severity, url, value FROM iss")
def h2_crawl_issues(spark, d):
    pages = crawled(spark, d)
    links = _links(pages)
    return crawl.issues(pages, links, _checked(links))


@query(f"{_ISSUES} SELECT kind, severity, count(*)::BIGINT AS n FROM iss GROUP BY ALL UNION ALL SELECT 'links_unverified', 'note', count(*)::BIGINT FROM un WHERE length(target) % 5 = 0 HAVING count(*) > 0")
def h2_crawl_summary(spark, d):
    pages = crawled(spark, d)
    links = _links(pages)
    return crawl.summary(crawl.issues(pages, links, _checked(links)), pages, links, _checked(links))


@query(
    f"""{_ISSUES} SELECT (SELECT count(*) FROM cr)::BIGINT AS pages_crawled, (SELECT count(*) FROM ok)::BIGINT AS pages_ok, (SELECT count(*) FROM ok WHERE len(schema_types) > 0)::BIGINT AS with_schema,
count(*) FILTER (severity = 'fail')::BIGINT AS fail, count(*) FILTER (severity = 'warn')::BIGINT AS warn, count(*) FILTER (kind = 'orphan')::BIGINT AS orphans, (SELECT list_sort(list(words))[count(*) // 2 + 1] FROM ok)::BIGINT AS words_median FROM iss"""
)
def h4_crawl_totals(spark, d):
    pages = crawled(spark, d)
    links = _links(pages)
    return crawl.totals(crawl.issues(pages, links, _checked(links)), pages)
