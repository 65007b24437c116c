"""Articles for answer engines: structure plans, schema graphs, language links, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

#: Bullets of a summary and questions that an article takes. Fixed values.
BULLETS, FAQS = 5, 10
BLOCK = "array<struct<type:string,text:string>>"


def _block(kind: Column | str, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), text.alias("text"))


def _given(name: str) -> Column:
    return F.nullif(T.strip(F.coalesce(F.col(name), F.lit(""))), F.lit(""))


def apply_structure(articles: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """articles with what a writer's plan gives for them; rows without a plan stay.

    plans: key, title, meta_description, tldr (array), tldr_heading, answers (map of heading to answer), blocks (null: the
    article's own), faqs, images_alt (map of src to alt). A summary comes first, an answer right after its heading: the very
    one that the plan names where there is one, else those that differ from it by white space around.
    """
    names = ("title", "meta_description", "tldr", "tldr_heading", "answers", "blocks", "faqs", "images_alt")
    rows = articles.join(plans.select(key, *(F.col(n).alias(f"_p_{n}") for n in names), F.lit(True).alias("_planned")), key, "left")
    bullets = F.slice(F.filter(F.transform(F.coalesce("_p_tldr", F.array().cast("array<string>")), T.strip), lambda x: x != ""), 1, BULLETS)
    summary = F.when(F.size(bullets) > 0, F.concat(F.array(_block("h2", F.coalesce(_given("_p_tldr_heading"), F.lit("TL;DR")))), F.transform(bullets, lambda x: _block("tldr", x)))).otherwise(F.array().cast(BLOCK))
    answers = F.filter(F.map_entries(F.coalesce("_p_answers", F.create_map().cast("map<string,string>"))), lambda e: T.strip(e["value"]) != "")

    def given(which, named) -> Column:
        return F.map_from_entries(F.transform(F.filter(answers, which), lambda e: F.struct(named(e["key"]).alias("key"), T.strip(e["value"]).alias("value"))))
    rows = rows.withColumn("_source", F.coalesce("_p_blocks", "blocks"))
    rows = rows.withColumn("_named", F.transform(F.filter("_source", lambda b: b["type"].isin("h2", "h3")), lambda b: b["text"]))
    rows = rows.withColumns({"_summary": summary, "_exact": given(lambda e: F.array_contains("_named", e["key"]), lambda k: k), "_wanted": given(lambda e: ~F.array_contains("_named", e["key"]), T.strip)})

    def answered(b: Column) -> Column:
        answer = F.coalesce(F.try_element_at("_exact", b["text"]), F.try_element_at("_wanted", T.strip(b["text"])))
        return F.when(b["type"].isin("h2", "h3") & answer.isNotNull(), F.array(_block(b["type"], b["text"]), _block("answer", answer))).otherwise(F.array(_block(b["type"], b["text"])))

    faqs = F.slice(F.filter(F.coalesce("_p_faqs", F.array().cast("array<struct<q:string,a:string>>")), lambda f: (T.strip(F.coalesce(f["q"], F.lit(""))) != "") & (T.strip(F.coalesce(f["a"], F.lit(""))) != "")), 1, FAQS)
    alt = lambda i: F.coalesce(F.try_element_at("_p_images_alt", i["src"]), i["alt"])
    planned = F.coalesce("_planned", F.lit(False))
    rows = rows.withColumns(
        {
            "title": F.coalesce(_given("_p_title"), "title"),
            "meta_description": F.coalesce(_given("_p_meta_description"), "meta_description"),
            "blocks": F.when(planned, F.concat("_summary", F.flatten(F.transform("_source", answered)))).otherwise(F.col("blocks")),
            "faqs": F.when(F.size(faqs) > 0, faqs).otherwise(F.col("faqs")),
            "images": F.when(F.col("_p_images_alt").isNotNull(), F.transform("images", lambda i: F.struct(i["src"].alias("src"), alt(i).alias("alt")))).otherwise(F.col("images")),
        }
    )
    return rows.drop("_summary", "_exact", "_wanted", "_named", "_source", "_planned", *(f"_p_{n}" for n in names))


def answer_fits(text: Column) -> Column:
    """Whether an answer has about the length that is quoted."""
    return T.word_count(text).between(30, 75)


def named_things(brand: Column | str | None = None) -> Column:
    """Up to eight things the article is about, sorted: the brand, and its first headings without enumerators."""
    heads = F.slice(F.filter("blocks", lambda b: b["type"].isin("h2", "h3")), 1, 10)
    cleaned = F.transform(heads, lambda b: F.trim(F.regexp_replace(b["text"], rf"^{T.WS}*[0-9]+[.)]{T.WS}*", ""), F.lit(" ?:।")))
    found = F.filter(cleaned, lambda x: (F.length(x) > 2) & (F.length(x) < 60))
    if brand is not None:
        found = F.concat(F.array_compact(F.array(F.nullif(brand if isinstance(brand, Column) else F.lit(brand), F.lit("")))), found)
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 8)


def with_schema(articles: DataFrame, as_of: str, brand: str = "Publisher", location: str | None = None, organisation: str = "Organization", health: bool = False, lang: str = "en") -> DataFrame:
    """articles with schema (JSON-LD): the article, its publisher, FAQs if there are some, and breadcrumbs.

    articles: source_url, title, meta_description, author, author_credentials, published, images, blocks, faqs, text. as_of is
    the date of modification, a parameter as there is no wall clock. Null fields are left out.
    """
    url = F.coalesce("source_url", F.lit(""))
    base = F.when(F.contains(url, F.lit("/")), F.regexp_replace(url, "/[^/]*$", "")).otherwise(url)
    at = lambda kind: F.concat(url, F.lit(f"#{kind}"))
    publisher = F.struct(F.lit(organisation).alias("@type"), F.concat(base, F.lit("#organization")).alias("@id"), F.lit(brand).alias("name"), *([F.struct(F.lit("PostalAddress").alias("@type"), F.lit(location).alias("addressLocality")).alias("address")] if location else []))
    name = F.nullif(F.coalesce("author", F.lit("")), F.lit(""))
    role = [F.coalesce(F.nullif("author_credentials", F.lit("")), F.lit("Reviewed by the medical team")).alias("jobTitle")] if health else []
    author = F.struct(F.when(F.contains(name, F.lit(" ")), "Person").otherwise("Organization").alias("@type"), F.coalesce(name, F.lit(brand)).alias("name"), *role)
    images = F.when(F.size("images") > 0, F.transform(F.slice("images", 1, 3), lambda i: i["src"]))
    things = named_things(brand)
    article = F.struct(
        F.lit("MedicalWebPage" if health else "Article").alias("@type"),
        at("article").alias("@id"),
        F.substring("title", 1, 110).alias("headline"),
        F.col("meta_description").alias("description"),
        F.lit("hi-Latn" if lang == "hinglish" else lang).alias("inLanguage"),
        F.coalesce(F.nullif("published", F.lit("")), F.lit(as_of)).alias("datePublished"),
        F.lit(as_of).alias("dateModified"),
        author.alias("author"),
        publisher.alias("publisher"),
        F.struct(F.lit("WebPage").alias("@type"), url.alias("@id")).alias("mainEntityOfPage"),
        T.word_count(F.col("text")).alias("wordCount"),
        F.struct(F.lit("SpeakableSpecification").alias("@type"), F.array(F.lit(".tldr"), F.lit("h1")).alias("cssSelector")).alias("speakable"),
        images.alias("image"),
        *([author.alias("reviewedBy"), F.lit(as_of).alias("lastReviewed")] if health else []),
        F.when(F.size(things) > 0, F.transform(things, lambda x: F.struct(F.lit("Thing").alias("@type"), x.alias("name")))).alias("about"),
    )
    question = lambda f: F.struct(F.lit("Question").alias("@type"), f["q"].alias("name"), F.struct(F.lit("Answer").alias("@type"), f["a"].alias("text")).alias("acceptedAnswer"))
    faqs = F.when(F.size("faqs") > 0, F.to_json(F.struct(F.lit("FAQPage").alias("@type"), at("faq").alias("@id"), F.transform("faqs", question).alias("mainEntity"))))
    step = lambda n, what, where: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), what.alias("name"), where.alias("item"))
    crumbs = F.struct(F.lit("BreadcrumbList").alias("@type"), at("breadcrumb").alias("@id"), F.array(step(1, F.lit(brand), base), step(2, F.substring("title", 1, 90), url)).alias("itemListElement"))
    graph = F.array_compact(F.array(F.to_json(article), F.to_json(publisher), faqs, F.to_json(crumbs)))
    return articles.withColumn("schema", F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(graph, ","), F.lit("]}")))


def hreflang(variants: DataFrame, key: str, default: str = "en") -> DataFrame:
    """key, hreflang, href: an alternate for each language variant (key, lang, url), and x-default."""
    codes = {x["code"]: f"{x['engine']}-IN" for x in L.LANGUAGES} | {"hinglish": "hi-Latn-IN", "en": "en"}
    known = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    code = F.coalesce(F.try_element_at(known, F.col("lang")), F.concat("lang", F.lit("-IN")))
    own = variants.select(key, code.alias("hreflang"), F.col("url").alias("href"))
    return own.unionAll(variants.filter(F.col("lang") == default).select(key, F.lit("x-default").alias("hreflang"), F.col("url").alias("href")))


def _kinds() -> Column:
    """Each block with what it is to the lists around it: the kind of list it is in, and those of the blocks next to it."""
    listed = lambda b: F.when(b["type"] == "tldr", "tldr").when(b["type"] == "li", "li").otherwise("")
    at = lambda i: listed(F.get("blocks", i))
    return F.transform("blocks", lambda b, i: F.struct(b["type"].alias("type"), b["text"].alias("text"), listed(b).alias("own"), F.coalesce(F.when(i > 0, at(i - 1)), F.lit("")).alias("before"), F.coalesce(at(i + 1), F.lit("")).alias("after")))


def render_html(articles: DataFrame, lang: str = "en") -> DataFrame:
    """articles with html: head tags and body, escaped, lists and the summary grouped. Canonical and schema if there are such columns."""
    e, line = T.escape_html, "\n"
    title, about = e(F.coalesce("title", F.lit(""))), e(F.coalesce("meta_description", F.lit("")))
    head = [F.concat(F.lit("<title>"), title, F.lit("</title>")), F.concat(F.lit('<meta name="description" content="'), about, F.lit('">')), F.concat(F.lit('<meta property="og:title" content="'), title, F.lit('">')), F.concat(F.lit('<meta property="og:description" content="'), about, F.lit('">')), F.lit('<meta property="og:type" content="article">')]
    if "canonical" in articles.columns:
        head.append(F.when(F.col("canonical") != "", F.concat(F.lit('<link rel="canonical" href="'), e(F.col("canonical")), F.lit('">'))))
    if "schema" in articles.columns:
        head.append(F.when(F.col("schema").isNotNull(), F.concat(F.lit('<script type="application/ld+json">\n'), F.col("schema"), F.lit("\n</script>"))))

    def one(b: Column) -> Column:
        t, kind = e(b["text"]), b["type"]
        opening = F.when((b["own"] != "") & (b["own"] != b["before"]), F.when(b["own"] == "tldr", '  <aside class="tldr"><ul>\n').otherwise("  <ul>\n")).otherwise("")
        closing = F.when((b["own"] != "") & (b["own"] != b["after"]), F.when(b["own"] == "tldr", "\n  </ul></aside>").otherwise("\n  </ul>")).otherwise("")
        item = F.concat(opening, F.lit("    <li>"), t, F.lit("</li>"), closing)
        tagged = lambda a, z: F.concat(F.lit(f"  {a}"), t, F.lit(z))
        return (
            F.when(b["own"] != "", item)
            .when(kind.isin("h2", "h3"), F.concat(F.lit("  <"), kind, F.lit(">"), t, F.lit("</"), kind, F.lit(">")))
            .when(kind == "answer", tagged('<p class="answer"><strong>', "</strong></p>"))
            .when(kind == "quote", tagged("<blockquote>", "</blockquote>"))
            .when(kind == "code", tagged("<pre>", "</pre>"))
            .otherwise(tagged("<p>", "</p>"))
        )

    faqs = F.when(F.size("faqs") > 0, F.concat(F.lit('  <section class="faq">\n    <h2>FAQ</h2>\n'), F.array_join(F.transform("faqs", lambda f: F.concat(F.lit("    <h3>"), e(f["q"]), F.lit("</h3>\n    <p>"), e(f["a"]), F.lit("</p>"))), line), F.lit("\n  </section>")))
    body = F.array_compact(F.concat(F.array(F.lit(f'<article lang="{lang}">'), F.concat(F.lit("  <h1>"), title, F.lit("</h1>"))), F.transform("_k", one), F.array(faqs, F.lit("</article>"))))
    rows = articles.withColumn("_k", _kinds())
    return rows.withColumn("html", F.concat(F.lit("<!-- head -->\n"), F.array_join(F.array_compact(F.array(*head)), line), F.lit("\n\n<!-- body -->\n"), F.array_join(body, line), F.lit("\n"))).drop("_k")


def render_markdown(articles: DataFrame) -> DataFrame:
    """articles with markdown: title, description, blocks, FAQs; a blank line after each block and after each list."""
    def one(b: Column) -> Column:
        mark = lambda before, after="": F.concat(F.lit(before), b["text"], F.lit(after + "\n"))
        ends = F.when(b["after"] == "", "\n").otherwise("")
        kind = b["type"]
        return F.when(b["own"] != "", F.concat(F.lit("- "), b["text"], ends)).when(kind == "h2", mark("## ")).when(kind == "h3", mark("### ")).when(kind == "answer", mark("**", "**")).when(kind == "quote", mark("> ")).otherwise(mark(""))

    rows = articles.withColumn("_k", _kinds())
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n"))
    about = F.when(F.coalesce("meta_description", F.lit("")) != "", F.concat(F.lit("> "), "meta_description", F.lit("\n")))
    faqs = F.when(F.size("faqs") > 0, F.concat(F.lit("\n## FAQ\n\n"), F.array_join(F.transform("faqs", lambda f: F.concat(F.lit("### "), f["q"], F.lit("\n\n"), f["a"], F.lit("\n"))), "\n")))
    parts = F.array_compact(F.concat(F.array(head, about), F.transform("_k", one), F.array(faqs)))
    return rows.withColumn("markdown", F.concat(F.array_join(parts, "\n"), F.lit("\n"))).drop("_k")
