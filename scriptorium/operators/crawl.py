"""What a crawl's page rows say about a site: one row an issue and page, their counts with notes, the totals.

pages: url, final_url (where a redirect ended; null or empty: none), redirects, status, error (null or empty: none), and html.page_rows'
title, description, h1, words, content_hash, canonical, robots, images_no_alt, schema_types. A page is good if its status is 200 and
it has no error; all but redirect and error look at good pages only. No list holds the pages of a value or a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from .corpus import upper_median

#: Checks of links between pages mean something only of a whole crawl.
FEW = 3


def _some(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def _final() -> Column:
    return F.rtrim(F.when(_some("final_url"), F.col("final_url")).otherwise(F.col("url")), F.lit("/"))


def good(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("status") == 200) & ~_some("error"))


def page_issues(pages: DataFrame) -> DataFrame:
    """kind, severity, url, value: the defects of single pages; one scan."""
    fine = F.coalesce((F.col("status") == 200) & ~_some("error"), F.lit(False))
    title, described = _some("title"), _some("description")
    n, d = F.length("title"), F.length("description")

    def one(kind: str, severity: str, when: Column, value: Column, of: Column = fine) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.coalesce(value.cast("string"), F.lit("")).alias("value"))
        return F.when(of & when, row)

    none, always = F.lit(""), F.lit(True)
    found = F.array(
        one("missing_title", "fail", ~title, none),
        one("title_length", "warn", title & ~n.between(L.TITLE_MIN, L.TITLE_MAX), n),
        one("missing_meta", "fail", ~described, none),
        one("meta_length", "warn", described & ~d.between(L.DESCRIPTION_MIN, L.DESCRIPTION_MAX), d),
        one("thin", "warn", (F.col("words") > 0) & (F.col("words") < L.THIN_WORDS), F.col("words")),
        one("no_h1", "warn", F.coalesce(F.size("h1"), F.lit(0)) < 1, none),
        one("multi_h1", "warn", F.size("h1") > 1, F.size("h1")),
        one("no_schema", "warn", F.coalesce(F.size("schema_types"), F.lit(0)) < 1, none),
        one("images_no_alt", "warn", F.col("images_no_alt") > 0, F.col("images_no_alt")),
        one("noindex", "fail", F.contains("robots", F.lit("noindex")), F.col("robots")),
        one("canonical_conflict", "fail", _some("canonical") & (F.rtrim("canonical", F.lit("/")) != _final()), F.col("canonical")),
        one("redirect", "warn", F.col("redirects") > 0, F.col("final_url")),
        one("error_status", "fail", F.coalesce(F.col("status") >= 400, F.lit(False)) | _some("error"), F.when(_some("error"), F.col("error")).otherwise(F.col("status").cast("string")), always),
    )
    rows = pages.select("url", F.explode_outer(F.array_compact(found)).alias("_i")).filter("_i is not null")
    return rows.select("_i.kind", "_i.severity", "url", "_i.value")


def duplicate_issues(pages: DataFrame) -> DataFrame:
    """The same of titles, descriptions and bodies that several good pages share, a row a page: values are counted, then met again.

    A value that all pages share is one row of the counts; the join deals pages by url and value where it is too large to send.
    """
    kinds = {"duplicate_title": ("fail", F.lower(F.trim("title"))), "duplicate_meta": ("warn", F.lower(F.trim("description"))), "duplicate_content": ("fail", F.when(F.col("words") > 100, F.col("content_hash")))}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.nullif(v, F.lit("")).alias("value")) for k, (s, v) in kinds.items()))
    rows = good(pages).select("url", F.explode_outer(each).alias("_v")).select("url", "_v.*").filter("value is not null")
    shared = rows.groupBy("kind", "value").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(shared, ["kind", "value"]).select("kind", "severity", "url", F.substring("value", 1, 90).alias("value"))


def link_issues(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The same of good pages that no page of the site links to, or fewer than three. links: corpus.link_rows of the good pages.

    Pages with one address are one target, and each is a row.
    """
    inbound = links.filter("internal").groupBy(F.col("target").alias("_final")).agg(F.count("*").alias("_n"))
    rows = good(pages).select("url", _final().alias("_final")).join(inbound, "_final", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    kind = F.when(F.col("_n") == 0, "orphan").otherwise("few_inbound")
    return rows.filter(F.col("_n") < FEW).select(kind.alias("kind"), F.when(F.col("_n") == 0, "fail").otherwise("warn").alias("severity"), "url", F.col("_n").cast("string").alias("value"))


def unknown_targets(pages: DataFrame, links: DataFrame) -> DataFrame:
    """target, url (the first page that links to it): internal targets that aren't good pages of the crawl."""
    known = good(pages).select(_final().alias("target")).distinct()
    return links.filter("internal").join(known, "target", "left_anti").groupBy("target").agg(F.min("url").alias("url"))


def broken_links(pages: DataFrame, links: DataFrame, checked: DataFrame) -> DataFrame:
    """The same of internal links whose targets a request found broken. checked: target, status (null: no answer)."""
    asked = unknown_targets(pages, links).join(checked.select("target", "status").dropDuplicates(["target"]), "target")
    bad = F.col("status").isNull() | (F.col("status") >= 400)
    return asked.filter(bad).select(F.lit("broken_internal").alias("kind"), F.lit("fail").alias("severity"), "url", F.col("target").alias("value"))


def issues(pages: DataFrame, links: DataFrame, checked: DataFrame, complete: bool = True) -> DataFrame:
    """kind, severity, url, value: all of the above. Of a crawl that isn't complete, links between its pages are not judged."""
    found = page_issues(pages).unionByName(duplicate_issues(pages)).unionByName(broken_links(pages, links, checked))
    return found.unionByName(link_issues(pages, links)) if complete else found


def summary(found: DataFrame, pages: DataFrame, links: DataFrame, checked: DataFrame, complete: bool = True) -> DataFrame:
    """kind, severity, n of issues, and notes: how many internal targets nobody checked, and that links weren't judged."""
    rows = found.groupBy("kind", "severity").agg(F.count("*").alias("n"))
    left = unknown_targets(pages, links).join(checked.select("target"), "target", "left_anti").agg(F.count("*").alias("n")).filter("n > 0")
    rows = rows.unionByName(left.select(F.lit("links_unverified").alias("kind"), F.lit("note").alias("severity"), "n"))
    if complete:
        return rows
    skipped = found.sparkSession.range(1).select(F.lit("link_graph_skipped").alias("kind"), F.lit("note").alias("severity"), F.lit(0).cast("long").alias("n"))
    return rows.unionByName(skipped)


def totals(found: DataFrame, pages: DataFrame, complete: bool = True) -> DataFrame:
    """One row: pages_crawled, pages_ok, fail, warn, words_median, with_schema, orphans (null of an incomplete crawl)."""
    fine = F.coalesce((F.col("status") == 200) & ~_some("error"), F.lit(False))

    def of(when: Column, name: str) -> Column:
        return F.count(F.when(when, 1)).alias(name)

    crawled = pages.agg(F.count("*").alias("pages_crawled"), of(fine, "pages_ok"), of(fine & (F.size("schema_types") > 0), "with_schema"))
    judged = found.agg(of(F.col("severity") == "fail", "fail"), of(F.col("severity") == "warn", "warn"), of(F.col("kind") == "orphan", "orphans"))
    median = upper_median(good(pages), "words").select(F.coalesce("median", F.lit(0)).cast("long").alias("words_median"))
    rows = crawled.crossJoin(F.broadcast(judged)).crossJoin(F.broadcast(median))
    return rows.withColumn("orphans", F.col("orphans") if complete else F.lit(None).cast("long"))
