"""Page and article rows from HTML by expressions that stay on the JVM. Pages are read whole; broken markup is met as it comes."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOISE = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
FURNITURE = r"(?is)<nav[^>]*>.*?</nav>|<footer[^>]*>.*?(</footer>|$)|<header[^>]*>.*?</header>|<aside[^>]*>.*?</aside>|<form[^>]*>.*?</form>|<head[^>]*>.*?</head>"
TAG = r"(?s)<[^>]*>"
BLOCK = r"(?i)<(h[1-4]|p|li|blockquote|pre)(?:[ \t\n][^>]*)?>"
#: What stands between a tag's name and its end; quoted values may hold a closing bracket.
ATTRIBUTES = r"(?:[ \t\r\n/](?:\"[^\"]*\"|'[^']*'|[^>\"'])*)?"
REFERENCE = r"(?s)^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);(.*)$"
#: Characters by the names of their references, as the standard library lists them.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
#: Addresses that lead to no page.
NO_PAGE = r"(?i)^(mailto|tel|javascript|data):|^#"


def decode(t: Column) -> Column:
    """Character references, each once: what a decoded one makes with its surroundings is no reference."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # one literal in the plan

    def point(code: Column) -> Column:
        return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def one(p: Column) -> Column:
        name, rest = F.regexp_extract(p, REFERENCE, 1), F.regexp_extract(p, REFERENCE, 2)
        code = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substring(name, 3, 6), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 7)).cast("long")
        return F.coalesce(F.concat(F.coalesce(F.try_element_at(named, name), point(code)), rest), F.concat(F.lit("&"), p))

    parts = F.split(t, "&")
    whole = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(F.contains(t, F.lit("&")), whole).otherwise(t)


def plain(t: Column) -> Column:
    return T.clean(F.replace(decode(F.regexp_replace(t, TAG, " ")), F.lit(" "), F.lit(" ")))


def first(t: Column, pattern: str) -> Column:
    return plain(F.regexp_extract(t, pattern, 1))


def tags(t: Column, name: str) -> Column:
    return F.regexp_extract_all(t, F.lit(rf"(?i)<{name}{ATTRIBUTES}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's attribute, quoted either way or not at all; empty where there is none."""
    value = F.regexp_extract(tag, rf"(?is)[ \t\r\n\"'/]{name}[ \t\r\n]*=[ \t\r\n]*(\"[^\"]*\"|'[^']*'|[^ \t\r\n\"'>]+)", 1)
    return decode(F.regexp_replace(value, r"^[\"']|[\"']$", ""))


def meta(t: Column, name: str, by: str = "name") -> Column:
    """The content of the first meta tag of that name, in whichever order its attributes stand."""
    found = F.filter(tags(t, "meta"), lambda m: F.lower(attribute(m, by)) == name)
    return T.clean(F.coalesce(attribute(F.get(found, F.lit(0)), "content"), F.lit("")))


def host(url: Column) -> Column:
    """Lower case, without "www."."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")


def slug(url: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"([^/]*)/*$", 1)


def absolute(href: Column, base: Column) -> Column:
    """An address as the page at base means it, without fragment and dot segments (three upward steps are resolved)."""
    href = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
    full = (
        F.when(F.rlike(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(href == "", F.concat(origin, path))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .otherwise(F.concat(origin, folder, href))
    )
    full = F.regexp_replace(full, r"/\./", "/")
    for _ in range(3):
        full = F.regexp_replace(full, r"(?<![:/])/(?!\.\./)[^/?#]+/\.\./", "/")
    return full


def structured(html: Column) -> Column:
    """The texts of the page's JSON-LD."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


#: A node of JSON-LD, of which types may be one or a list, and a document, which may hold a graph or be a list.
NODE = "struct<`@type`: string, datePublished: string, dateModified: string>"


def nodes(html: Column) -> Column:
    """The nodes of the page's JSON-LD: of its graph, of its list, or the document itself. What is no JSON gives none."""
    def of(text: Column) -> Column:
        graph = F.from_json(text, f"struct<`@graph`: array<{NODE}>>")["@graph"]
        listed = F.when(F.rlike(text, F.lit(r"^\s*\[")), F.from_json(text, f"array<{NODE}>"))
        single = F.array(F.from_json(text, NODE))
        return F.filter(F.coalesce(graph, listed, single), lambda n: n["@type"].isNotNull())

    return F.flatten(F.transform(structured(html), of))


def types(found: Column) -> Column:
    """The nodes' types, each once, sorted."""
    def of(n: Column) -> Column:
        listed = F.from_json(n["@type"], "array<string>")
        return F.when(F.startswith(n["@type"], F.lit("[")), listed).otherwise(F.array(n["@type"]))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, of))))


def page_rows(pages: DataFrame, html: str = "html", only: list[str] | None = None) -> DataFrame:
    """The columns of pages without the HTML, and title, description, author, dates, canonical, robots, lang, headings, words,
    hash, links of the page and of its body, images and types, or only those named. pages has a url.

    Columns that aren't asked for would be pruned from the scan, but take the driver seconds to plan.
    """
    h, raw = F.col("_h"), F.coalesce(F.col(html), F.lit(""))
    rows = pages.withColumn("_h", F.regexp_replace(raw, NOISE, ""))
    wanted = lambda *names: only is None or any(n in only for n in names)
    rows = rows.withColumn("_rest", F.regexp_replace(h, FURNITURE, " "))
    if wanted("published", "modified", "schema_types"):
        rows = rows.withColumn("_nodes", nodes(raw))
    if wanted("images", "images_no_alt"):
        rows = rows.withColumn("_images", tags(h, "img"))
    if wanted("words", "content_hash"):
        rows = rows.withColumn("_body", plain(F.col("_rest")))

    def hrefs(t: Column) -> Column:
        return F.filter(F.transform(tags(t, "a"), lambda a: attribute(a, "href")), lambda x: x != "")

    def date(name: str) -> Column:
        return F.coalesce(F.get(F.filter(F.transform("_nodes", lambda n: n[name]), lambda d: F.coalesce(d, F.lit("")) != ""), F.lit(0)), F.lit(""))

    def canonical() -> Column:
        found = F.filter(tags(h, "link"), lambda x: F.contains(F.lower(attribute(x, "rel")), F.lit("canonical")))
        return F.coalesce(attribute(F.get(found, F.lit(0)), "href"), F.lit(""))

    found = {
        "title": lambda: first(h, r"(?is)<title[^>]*>(.*?)</title>"),
        "description": lambda: F.coalesce(F.nullif(meta(h, "description"), F.lit("")), meta(h, "og:description", "property")),
        "author": lambda: meta(h, "author"),
        "published": lambda: date("datePublished"),
        "modified": lambda: date("dateModified"),
        "canonical": canonical,
        "robots": lambda: F.lower(meta(h, "robots")),
        "lang": lambda: F.coalesce(attribute(F.get(tags(h, "html"), F.lit(0)), "lang"), F.lit("")),
        "h1": lambda: F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), plain),
        "h2": lambda: F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<h2[^>]*>(.*?)</h2>"), F.lit(1)), plain),
        "words": lambda: T.word_count(F.col("_body")).cast("long"),
        "content_hash": lambda: F.substring(F.sha1(F.lower("_body")), 1, 16),
        "links": lambda: hrefs(h),
        "body_links": lambda: hrefs(F.col("_rest")),
        "images": lambda: F.size("_images").cast("long"),
        "images_no_alt": lambda: F.size(F.filter("_images", lambda i: F.trim(attribute(i, "alt")) == "")).cast("long"),
        "schema_types": lambda: types(F.col("_nodes")),
    }
    rows = rows.withColumns({n: make() for n, make in found.items() if only is None or n in only})
    return rows.drop("_h", "_rest", "_nodes", "_images", "_body", html)


def image_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, src, alt of the images outside the furniture; a lazily loaded one's address stands in data-src."""
    h = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), NOISE, ""), FURNITURE, " ")
    rows = pages.select(key, F.posexplode(tags(h, "img")).alias("pos", "_i"))
    src = F.coalesce(F.nullif(attribute(F.col("_i"), "src"), F.lit("")), attribute(F.col("_i"), "data-src"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), src.alias("src"), T.clean(attribute(F.col("_i"), "alt")).alias("alt")).filter("src != ''")


def anchor_rows(pages: DataFrame, key: str, html: str = "html", furniture: bool = True) -> DataFrame:
    """key, pos, href, text of the links that have a text."""
    h = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), NOISE, "")
    h = h if furniture else F.regexp_replace(h, FURNITURE, " ")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(h, F.lit(rf"(?is)<a{ATTRIBUTES}>.*?</a>"), F.lit(0))).alias("pos", "_a"))
    rows = rows.select(key, F.col("pos").cast("long").alias("pos"), attribute(F.regexp_extract("_a", rf"(?is)^<a{ATTRIBUTES}>", 0), "href").alias("href"), plain(F.col("_a")).alias("text"))
    return rows.filter("href != '' and text != ''")


def block_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, type, text of the blocks of at least two characters in page order, furniture out, no block twice in a row."""
    h = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), NOISE, ""), FURNITURE, " ")
    marked = F.regexp_replace(F.translate(h, "\u0001\u0002", "  "), BLOCK, "\u0001$1\u0002")  # which no text of a page holds now
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    kind = F.lower(F.regexp_extract(F.col("_p"), "^([^\u0002]*)\u0002", 1))
    rows = pages.select(key, F.posexplode(parts).alias("_i", "_p"))
    rows = rows.select(key, "_i", F.when(kind == "h4", "h3").when(kind == "blockquote", "quote").when(kind == "pre", "code").otherwise(kind).alias("type"), plain(F.regexp_extract("_p", "(?is)\u0002(.*?)(</(h[1-4]|p|li|blockquote|pre)>|$)", 1)).alias("text"))
    rows = rows.filter(F.length("text") >= 2)
    order = Window.partitionBy(key).orderBy("_i")
    rows = rows.withColumns({"_lt": F.lag("type").over(order), "_lx": F.lag("text").over(order)})
    rows = rows.filter(~(F.col("_lt").eqNullSafe(F.col("type")) & F.col("_lx").eqNullSafe(F.col("text"))))
    return rows.select(key, (F.row_number().over(order) - 1).cast("long").alias("pos"), "type", "text")


def article_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """An article row for each page: title (the first h1, else the page's), description, author, published, slug, source_url,
    blocks without h1, images, links, faqs and schema_types."""
    from . import markdown

    rows = page_rows(pages, html)
    blocks = block_rows(pages, key, html)
    head = F.col("type") == "h1"
    packed = blocks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(~head, F.struct("pos", "type", "text")))).alias("_b"), F.min_by(F.when(head, F.col("text")), F.when(head, F.col("pos"))).alias("_h1")
    )
    gathered = lambda df, *of: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *of))).alias("_x"))
    images = gathered(image_rows(pages, key, html), "src", "alt").withColumnRenamed("_x", "_im")
    links = gathered(anchor_rows(pages, key, html, furniture=False), "href", "text").withColumnRenamed("_x", "_li")
    faqs = gathered(markdown.faqs(blocks, key), "q", "a").withColumnRenamed("_x", "_fa")
    for other in (packed, images, links, faqs):
        rows = rows.join(other, key, "left")

    def shaped(column: str, kind: str, *of: str) -> Column:
        return F.coalesce(F.transform(column, lambda x: F.struct(*(x[n].alias(n) for n in of))), F.array().cast(f"array<struct<{kind}>>"))

    return rows.select(
        key,
        F.coalesce(F.nullif("_h1", F.lit("")), F.col("title")).alias("title"),
        F.col("description").alias("meta_description"),
        "author",
        "published",
        slug(F.col("url")).alias("slug"),
        F.col("url").alias("source_url"),
        "lang",
        shaped("_b", "type:string,text:string", "type", "text").alias("blocks"),
        shaped("_im", "src:string,alt:string", "src", "alt").alias("images"),
        shaped("_li", "href:string,text:string", "href", "text").alias("links"),
        shaped("_fa", "q:string,a:string", "q", "a").alias("faqs"),
        "schema_types",
    )
