"""robots.txt, sitemaps and llms.txt as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Crawlers of answer engines that robots.txt may name. Fixed values.
AGENTS = ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "Claude-Web", "PerplexityBot", "Perplexity-User", "Google-Extended", "Applebot-Extended", "CCBot", "Bytespider", "meta-externalagent"]


def robots_rules(df: DataFrame, key: str, text: str = "robots") -> DataFrame:
    """key, agent, field (agent, allow, disallow), value. Each user-agent line starts a block of its own: of several in a row only the last gets the rules."""
    line = F.trim(F.regexp_replace("_line", "#.*$", ""))
    rows = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("_i", "_line")).withColumn("_line", line)
    field = F.lower(F.trim(F.regexp_extract("_line", "^([^:]*):", 1)))
    rows = rows.withColumns({"field": field, "value": F.trim(F.regexp_extract("_line", "^[^:]*:(.*)$", 1))}).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agent = F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(order)
    rows = rows.withColumn("agent", agent).filter("agent is not null")
    return rows.select(key, "agent", F.when(F.col("field") == "user-agent", "agent").otherwise(F.col("field")).alias("field"), "value")


def crawler_access(df: DataFrame, key: str, text: str = "robots", agents: list[str] = AGENTS) -> DataFrame:
    """key, agent, state (allowed, blocked, blocked_by_wildcard), explicit."""
    rules = robots_rules(df, key, text).groupBy(key, "agent").agg(F.max((F.col("field") == "disallow") & (F.col("value") == "/")).alias("shut"))
    named = df.select(key, F.explode(F.array(*map(F.lit, agents))).alias("name")).withColumn("agent", F.lower("name"))
    wild = rules.filter("agent = '*'").select(key, F.col("shut").alias("wild"))
    rows = named.join(rules, [key, "agent"], "left").join(wild, key, "left")
    state = F.when(F.col("shut"), "blocked").when(F.col("shut").isNull() & F.coalesce("wild", F.lit(False)), "blocked_by_wildcard").otherwise("allowed")
    return rows.select(key, F.col("name").alias("agent"), state.alias("state"), F.col("shut").isNotNull().alias("explicit"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls (path) that no rule of "*" shuts out: the longest prefix decides, allow on ties.

    Prefixes of each path meet the rules in an equi-join.
    """
    wild = rules.filter("agent = '*' and field != 'agent' and value != ''").select("field", F.col("value").alias("_prefix"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda n: F.substring(F.col("path"), F.lit(1), n))
    hits = urls.select("path").distinct().withColumn("_prefix", F.explode(prefixes)).join(wild, "_prefix")
    best = hits.groupBy("path").agg(F.max(F.struct(F.length("_prefix"), (F.col("field") == "allow"))).alias("_b"))
    shut = best.filter(~F.col("_b")["col2"]).select("path")
    return urls.join(shut, "path", "left_anti")


def sitemap_of_robots(robots: Column) -> Column:
    return F.regexp_extract(robots, r"(?im)^[ \t]*sitemap:[ \t]*(\S+)", 1)


#: Ends of addresses that are no pages. Fixed values.
NO_PAGE = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".mp4", ".mp3", ".zip", ".xml", ".css", ".js")


def sitemap_urls(xml: Column) -> Column:
    """The addresses of a urlset or sitemapindex, in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:[a-z0-9]+:)?loc>\s*(.*?)\s*</(?:[a-z0-9]+:)?loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_index(xml: Column) -> Column:
    return F.rlike(xml, F.lit(r"(?i)<(?:[a-z0-9]+:)?sitemapindex"))


def walk_sitemaps(spark: SparkSession, files: DataFrame, start: list[str], most: int = 25) -> DataFrame:
    """url: the pages reachable from the sitemaps `start`, breadth first, over files (url, xml).

    A frontier is a DataFrame; visited ones are left out by an anti-join, and at most `most` sitemaps are read.
    """
    frontier = spark.createDataFrame([(u,) for u in start], "url string")
    seen, pages, read = frontier, None, 0
    while read < most:
        maps = files.join(frontier.limit(most - read), "url").withColumns({"_urls": sitemap_urls(F.col("xml")), "_index": is_index(F.col("xml"))})
        found = maps.select("_index", F.explode("_urls").alias("url"))
        own = found.filter("not _index").select("url")
        pages = own if pages is None else pages.unionAll(own)
        n = maps.count()
        nested = found.filter("_index").select("url").distinct().join(seen, "url", "left_anti")
        if not n or not nested.limit(1).count():
            break
        read, frontier, seen = read + n, nested, seen.unionAll(nested)
    return pages.distinct().filter(~F.rlike("url", F.lit(rf"(?i)({'|'.join(x.replace('.', chr(92) + '.') for x in NO_PAGE)})$")))


def section_of(url: Column) -> Column:
    """The first segment of the path with a capital, or Pages."""
    path = F.trim(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    return F.coalesce(F.nullif(F.initcap(F.split(path, "/")[0]), F.lit("")), F.lit("Pages"))


def llms_txt(pages: DataFrame, most: int = 40) -> DataFrame:
    """section, n, text: links of each site section, the longest pages first, so many a section, with what they are about."""
    k = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("words"), "url"))
    rows = pages.withColumn("section", section_of(F.col("url"))).withColumn("k", k)
    total = rows.groupBy("section").agg(F.count("*").alias("n"))
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url"))
    about = F.when(F.trim("description") != "", F.concat(F.lit(": "), F.substring(F.trim("description"), 1, 110))).otherwise("")
    line = F.struct("k", F.concat(F.lit("- ["), name, F.lit("]("), "url", F.lit(")"), about).alias("line"))
    listed = rows.filter(F.col("k") <= most).groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))
    return listed.join(total, "section").select("section", "n", "text")


def llms_file(sections: DataFrame, brand: str, summary: str) -> DataFrame:
    """text: the whole file, sections by size (a row for each section meets)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "section", "text")))
    parts = F.transform(ordered, lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n\n"), x["text"], F.lit("\n")))
    return sections.agg(F.concat(F.lit(f"# {brand}\n\n> {summary}\n\n"), F.array_join(parts, "\n")).alias("text"))


def audit_llms(df: DataFrame, key: str, text: str = "llms") -> DataFrame:
    """key, present, has_h1, has_summary, n_sections, n_links, links of a site's llms.txt; null is none."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n")
    links = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\]\((https?://[^)]+)\)"), F.lit(1))
    return df.select(
        key,
        F.col(text).isNotNull().alias("present"),
        F.startswith(lines[0], F.lit("# ")).alias("has_h1"),
        F.exists(F.slice(lines, 1, 6), lambda x: F.startswith(x, F.lit("> "))).alias("has_summary"),
        F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("## ")))).cast("long").alias("n_sections"),
        F.size(links).cast("long").alias("n_links"),
        links.alias("links"),
    )


def llms_findings(audited: DataFrame, key: str) -> DataFrame:
    well = F.col("has_h1") & F.col("has_summary")
    one = lambda check, status, impact, when: F.when(when, F.struct(F.lit("manifest").alias("group"), F.lit(check).alias("check"), F.lit(status).alias("status"), F.lit(impact).alias("impact")))
    there = F.col("present")
    found = F.array_compact(F.array(one("llms_txt", "warn", "medium", ~there), one("llms_format", "warn", "low", there & ~well), one("llms_txt", "pass", "medium", there & well), one("llms_links", "warn", "low", there & (F.col("n_links") < 5))))
    return audited.select(key, F.explode(found).alias("_f")).select(key, "_f.*")


def coverage(audited: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """key, coverage: the share of a site's addresses (key, url) that its llms.txt links."""
    listed = audited.select(key, F.explode("links").alias("url")).select(key, F.rtrim("url", F.lit("/")).alias("url")).distinct().withColumn("_in", F.lit(1))
    rows = urls.select(key, F.rtrim("url", F.lit("/")).alias("url")).join(listed, [key, "url"], "left")
    return rows.groupBy(key).agg(T.rounded(F.count("_in") / F.count("*"), 3).alias("coverage"))
