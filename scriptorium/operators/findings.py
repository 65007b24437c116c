"""Checks that give findings: rows of group, check, status (pass, warn, fail) and impact, one pass over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources import html
from . import similarity
from .articles import GENERIC_ANCHORS, structure

WEIGHT = {"fail": 1.0, "warn": 0.45, "pass": 0.0}
IMPACT = {"high": 1.6, "medium": 1.0, "low": 0.5}
#: Spelled-out boundaries, as a match may take the character before and after.
_B, _E = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
STATISTIC = rf"(?i){_B}[0-9]+(\.[0-9]+)?{T.WS}*((percent|per cent|million|billion|lakh|crore){_E}|%[\p{{L}}\p{{N}}_])"
SOURCE = rf"(?i){_B}(according to|per the|reported by|study|research|survey|data from|published in|found that|WHO|ICMR|NIH|Lancet|journal){_E}"
DEFINITION = rf"(?i){_B}[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_ \t\n\r\f\x0B-]{{2,40}}{T.WS}+(is|are|refers to|means|is defined as){T.WS}+(a|an|the|when){_E}"
STEP = rf"(?im)^[ \t]*(step[ \t]*[0-9]|(first|second|third|next|then|finally){_E})"
BLOCK_STEP = rf"(?i)^{T.WS}*(step{T.WS}*[0-9]|first|second|third|next|then|finally){_E}"
YEAR = rf"{_B}20[0-2][0-9]{_E}"
ENTITY = rf"(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]{{2,}}(?:[ \t\n\r\f\x0B]+[A-Z][a-z]{{2,}}){{0,3}})(?:[^\p{{L}}\p{{N}}_]|$)"
ORPHAN = rf"(?i)^(this|that|these|those|it|they|he|she|such|the former|the latter|here|there|then|also|however|therefore|moreover|furthermore|additionally|as a result|in addition|consequently|meanwhile|otherwise|instead){_E}"


def finding(group: str, check: str, status: Column, impact: Column | str) -> Column:
    """Null where the status is."""
    level = F.lit(impact) if isinstance(impact, str) else impact
    return F.when(status.isNotNull(), F.struct(F.lit(group).alias("group"), F.lit(check).alias("check"), status.alias("status"), level.alias("impact")))


#: Rows with what the findings need, and these, null where there is none.
Part = tuple[DataFrame, list[Column]]


def _rows(key: str, part: Part) -> DataFrame:
    df, found = part
    return _exploded(df, key, F.array_compact(F.array(*found)))


def _exploded(df: DataFrame, key: str, found: Column) -> DataFrame:
    """An array's findings as rows. Of a plain explode the optimiser infers that the array isn't empty and pushes that, with
    every expression the array comes from, below the projections that would compute them once."""
    return df.select(key, F.explode_outer(found).alias("_f")).filter("_f is not null").select(key, "_f.*")


def _either(bad: Column, worse: str = "warn") -> Column:
    return F.when(bad, worse).otherwise("pass")


def with_content(df: DataFrame, text: str = "text", name: str = "found") -> DataFrame:
    """df with an array of findings: length, readability, sentences, paragraphs (lines), padding, stock phrases and passives of a text."""
    t = F.col("_t")
    rows = T.with_flesch(df.withColumn("_t", T.strip(F.coalesce(F.col(text), F.lit("")))), "_t", "_flesch")
    rows = rows.withColumns({"_sents": T.sentences(t, ".!?।॥"), "_words": T.word_count(t), "_low": F.lower(t)})
    words, n = F.col("_words"), F.size("_sents")
    part = lambda of: of / F.greatest(n, F.lit(1))
    # columns of their own, as a finding names what it hangs on several times
    rows = rows.withColumns(
        {
            "_fat": F.exists(F.split(t, "\n"), lambda p: T.word_count(p) > 150),
            "_long": (n > 0) & (part(F.size(F.filter("_sents", lambda s: T.word_count(s) > 30))) > 0.18),
            "_padded": F.size(T.phrases_present(F.col("_low"), L.FILLER)) > 0,
            "_tells": F.size(T.phrases_present(F.col("_low"), L.AUDIT_TELLS)) >= 3,
            "_passive": (n > 0) & (part(T.regex_count(t, T.PASSIVE)) > 0.25),
            "_plain": (words > 700) & ~F.rlike(t, F.lit("(?m)^[-*] ")),
        }
    )
    length = F.when(words < 300, "fail").when(words < 600, "warn").otherwise("pass")
    found = F.array(
        finding("content", "length", length, F.when(words < 300, "high").otherwise("medium")),
        finding("content", "readability", _either(F.col("_flesch") < 45), "medium"),
        finding("content", "sentence_length", _either(F.col("_long")), F.when(F.col("_long"), "medium").otherwise("low")),
        finding("content", "paragraph_length", _either(F.col("_fat")), F.when(F.col("_fat"), "medium").otherwise("low")),
        finding("content", "filler", F.when(F.col("_padded"), "warn"), "low"),
        finding("content", "ai_tells", F.when(F.col("_tells"), "warn"), "low"),
        finding("content", "passive_voice", F.when(F.col("_passive"), "warn"), "low"),
        finding("content", "formatting", F.when(F.col("_plain"), "warn"), "medium"),
    )
    return rows.withColumn(name, F.array_compact(found)).drop("_t", "_flesch", "_sents", "_words", "_low", "_fat", "_long", "_padded", "_tells", "_passive", "_plain")


def content(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The findings of with_content as rows."""
    return _exploded(with_content(df, text, "_fs"), key, F.col("_fs"))


def _capitals(t: Column) -> Column:
    """Some letters, all of them capital."""
    return F.rlike(t, F.lit(r"\p{Lu}")) & ~F.rlike(t, F.lit(r"[\p{Ll}\p{Lt}]"))


def _text(name: str) -> Column:
    return T.strip(F.coalesce(F.col(name), F.lit("")))


def _title(articles: DataFrame) -> Part:
    t, kw = _text("title"), F.col("keyword")
    n, at = F.length(t), F.instr(F.lower(t), kw) - 1
    has = (t != "") & (kw != "")
    return articles, [
        finding("title", "present", F.when(t == "", "fail"), "high"),
        finding("title", "length", F.when(t != "", _either((n < L.TITLE_MIN) | (n > L.TITLE_MAX))), "medium"),
        finding("title", "keyword", F.when(has & (at < 0), "fail").when(has & (at <= 35), "pass"), "high"),
        finding("title", "keyword_position", F.when(has & (at > 35), "warn"), "medium"),
        finding("title", "case", F.when(_capitals(t), "warn"), "low"),
    ]


def title(articles: DataFrame, key: str, index: DataFrame | None = None) -> DataFrame:
    """Length, keyword, case and, against an index of posts (entry, tokens), a near duplicate. articles: title, keyword."""
    rows = _rows(key, _title(articles))
    if index is None:
        return rows
    t = _text("title")
    queries = articles.filter(t != "").select(key, T.token_set(t, L.SITE_STOP).alias("tokens"))
    near = similarity.best_match(queries, index, key, "entry").filter("status = 'covered'")
    return rows.unionByName(near.select(key, F.lit("title").alias("group"), F.lit("duplicate").alias("check"), F.lit("warn").alias("status"), F.lit("high").alias("impact")))


def _description(articles: DataFrame) -> Part:
    d, kw = _text("meta_description"), F.col("keyword")
    n, has = F.length(d), d != ""
    call = rf"(?i){_B}({'|'.join(L.CALLS)}){_E}"
    return articles, [
        finding("meta", "present", F.when(~has, "fail"), "high"),
        finding("meta", "length", F.when(has, _either((n < L.DESCRIPTION_MIN) | (n > L.DESCRIPTION_MAX))), "medium"),
        finding("meta", "keyword", F.when(has & (kw != ""), _either(~F.contains(F.lower(d), kw))), "medium"),
        finding("meta", "cta", F.when(has & ~F.rlike(d, F.lit(call)), "warn"), "low"),
    ]


def description(articles: DataFrame, key: str) -> DataFrame:
    """Length, keyword and call to action of the meta description."""
    return _rows(key, _description(articles))


def _headings(articles: DataFrame) -> Part:
    levels = F.filter(F.transform("blocks", lambda b: b["type"]), lambda k: k.isin("h1", "h2", "h3"))
    heads = F.transform(F.filter("blocks", lambda b: b["type"].isin("h2", "h3")), lambda b: b["text"])
    rows = articles.withColumns({"_levels": levels, "_heads": heads, "_h1": F.size(F.filter("blocks", lambda b: b["type"] == "h1"))})
    n, kw = F.size("_heads"), F.col("keyword")
    some, second = n > 0, F.array_position("_levels", F.lit("h2"))
    skipped = F.size(F.filter("_levels", lambda k: k == "h3")) > 0
    before = F.array_contains(F.when(second > 0, F.slice("_levels", 1, second.cast("int"))).otherwise(F.col("_levels")), F.lit("h3"))
    hits = F.size(F.filter("_heads", lambda h: F.contains(F.lower(h), kw)))
    asked = F.size(F.filter("_heads", T.is_question))
    stuffed = hits > F.greatest(F.lit(2), F.floor(n / 2))
    return rows, [
        finding("headings", "h1_count", _either(F.col("_h1") > 1, "fail"), F.when(F.col("_h1") > 1, "high").otherwise("medium")),
        finding("headings", "structure", F.when(~some, "fail"), "high"),
        finding("headings", "hierarchy", F.when(some, _either(skipped & before)), "medium"),
        finding("headings", "keyword", F.when(some & (kw != "") & ~((hits > 0) & stuffed), _either(hits == 0)), "medium"),
        finding("headings", "keyword_stuffing", F.when(some & (kw != "") & (hits > 0) & stuffed, "warn"), "medium"),
        finding("headings", "questions", F.when(some, _either(asked / F.greatest(n, F.lit(1)) < 0.3)), "medium"),
        finding("headings", "length", F.when(F.exists("_heads", lambda h: F.length(h) > 70), "warn"), "low"),
    ]


def headings(articles: DataFrame, key: str) -> DataFrame:
    """One h1, subheadings, their nesting, keyword, questions and length. articles: blocks, keyword."""
    return _rows(key, _headings(articles))


def _links(articles: DataFrame) -> Part:
    own = html.host(F.coalesce("source_url", F.lit("")))

    def inside(x: Column) -> Column:
        return F.startswith(x["href"], F.lit("/")) | ((own != "") & (html.host(x["href"]) == own))

    internal = F.exists("links", inside)
    external = F.exists("links", lambda x: F.startswith(x["href"], F.lit("http")) & ~inside(x))
    generic = F.exists("links", lambda x: F.lower(T.strip(x["text"])).isin(GENERIC_ANCHORS))
    return articles, [
        finding("links", "internal", _either(~internal), "medium"),
        finding("links", "external", _either(~external), F.when(external, "low").otherwise("medium")),
        finding("links", "anchor_text", F.when(generic, "warn"), "medium"),
    ]


def links(articles: DataFrame, key: str, broken: DataFrame | None = None) -> DataFrame:
    """Internal and external links and anchors that say nothing; broken ones by a table of checked addresses (href, status).

    Whether a link is broken is only known of addresses that were checked.
    """
    rows = _rows(key, _links(articles))
    if broken is None:
        return rows
    known = broken.select("href", (F.coalesce("status", F.lit(0)).between(1, 399)).alias("_ok"))
    asked = articles.select(key, F.explode("links").alias("_l")).select(key, F.col("_l.href").alias("href")).distinct().join(known, "href")
    found = asked.groupBy(key).agg(F.min("_ok").alias("_ok")).select(key, F.lit("links").alias("group"), F.lit("broken").alias("check"), _either(~F.col("_ok"), "fail").alias("status"), F.when(F.col("_ok"), "medium").otherwise("high").alias("impact"))
    return rows.unionByName(found)


def _images(articles: DataFrame) -> Part:
    some, kw = F.size("images") > 0, F.col("keyword")
    missing = F.exists("images", lambda i: T.strip(F.coalesce(i["alt"], F.lit(""))) == "")
    named = F.exists("images", lambda i: F.contains(F.lower(F.coalesce(i["alt"], F.lit(""))), kw))
    poor = F.exists("images", lambda i: F.rlike(i["src"], F.lit(r"(?i)/(img|image|photo|dsc|screenshot)[-_]?[0-9]*\.[A-Za-z0-9_]+$")))
    return articles, [
        finding("images", "present", F.when(~some, "warn"), "medium"),
        finding("images", "alt", F.when(some, _either(missing, "fail")), "high"),
        finding("images", "alt_keyword", F.when(some & (kw != "") & ~named, "warn"), "low"),
        finding("images", "filename", F.when(some & poor, "warn"), "low"),
    ]


def images(articles: DataFrame, key: str) -> DataFrame:
    """Images, their alternative texts, the keyword in one of them, and file names that say something."""
    return _rows(key, _images(articles))


def _technical(articles: DataFrame, base_url: str = "") -> Part:
    slug = F.coalesce("slug", F.lit(""))
    has, long = slug != "", F.length(slug) > L.SLUG_MAX
    odd = F.contains(slug, F.lit("_")) | F.rlike(slug, F.lit(r"[\p{Lu}\p{Lt}]"))
    some = F.size("schema_types") > 0
    whole = F.arrays_overlap("schema_types", F.array(F.lit("Article"), F.lit("MedicalWebPage"))) & ((F.size("faqs") == 0) | F.array_contains("schema_types", F.lit("FAQPage"))) & F.array_contains("schema_types", F.lit("BreadcrumbList"))
    known = F.lit(base_url != "") | (F.coalesce("source_url", F.lit("")) != "")
    return articles, [
        finding("technical", "slug", F.when(~has, "warn").when(~long & ~odd, "pass"), "medium"),
        finding("technical", "slug_length", F.when(has & long, "warn"), "low"),
        finding("technical", "slug_format", F.when(has & odd, "warn"), "low"),
        finding("technical", "slug_encoding", F.when(F.rlike(slug, F.lit("%[0-9A-Fa-f]{2}")), "warn"), "medium"),
        finding("technical", "schema", F.when(~some, "fail").when(whole, "pass"), "high"),
        finding("technical", "schema_types", F.when(some & ~whole, "warn"), "medium"),
        finding("technical", "canonical", _either(~known), "medium"),
    ]


def technical(articles: DataFrame, key: str, base_url: str = "") -> DataFrame:
    """Slug, structured data and canonical address. articles: slug, schema_types, faqs, source_url."""
    return _rows(key, _technical(articles, base_url))


def _answers(structured: DataFrame) -> Column:
    status = F.when(F.col("aeo") >= 70, "pass").when(F.col("aeo") >= 45, "warn").otherwise("fail")
    score = F.array(F.struct(F.lit("aeo").alias("group"), F.lit("score").alias("check"), status.alias("status"), F.lit("high").alias("impact")))
    each = F.transform("flags", lambda f: F.struct(F.lit("aeo").alias("group"), f["kind"].alias("check"), F.when(f["severity"] == "error", "fail").otherwise("warn").alias("status"), F.lit("medium").alias("impact")))
    return F.concat(score, each)


def answers(structured: DataFrame, key: str) -> DataFrame:
    """The answer-engine score (aeo, flags of articles.structure) as findings."""
    return _exploded(structured, key, _answers(structured))


def _trust(articles: DataFrame) -> Part:
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = articles.withColumn("_low", low)

    def any_of(words: list[str]) -> Column:
        return F.size(T.phrases_present(F.col("_low"), words)) > 0

    health = any_of(L.HEALTH)
    advised = F.rlike("_low", F.lit(rf"{_B}({'|'.join(L.ADVICE)}){_E}"))
    author, date = _text("author") != "", _text("published") != ""
    return rows, [
        finding("eeat", "author", _either(~author), "medium"),
        finding("eeat", "date", _either(~date), F.when(date, "low").otherwise("medium")),
        finding("eeat", "medical_disclaimer", F.when(health, _either(~advised, "fail")), "high"),
        finding("eeat", "credentials", F.when(health & (_text("author_credentials") == ""), "warn"), "high"),
        finding("eeat", "overclaim", F.when(health & any_of(L.OVERCLAIMS), "fail"), "high"),
    ]


def trust(articles: DataFrame, key: str) -> DataFrame:
    """Author, date and, on health topics, advice to see a clinician, credentials and absolute claims. articles: text (whole)."""
    return _rows(key, _trust(articles))


def with_audit(articles: DataFrame, name: str = "found", base_url: str = "") -> DataFrame:
    """articles with an array of all findings that need nothing but the article: of its answers, title, description, headings,
    links, images, technical matters and trust. One projection; the checks against other tables are title's, links' and
    cannibalisation's. articles has what these ask for."""
    rows = structure(articles)
    found = [_answers(rows)]
    for part in (_title, _description, _headings, _links, _images, lambda r: _technical(r, base_url), _trust):
        rows, more = part(rows)
        found.append(F.array_compact(F.array(*more)))
    return rows.withColumn(name, F.flatten(F.array(*found))).select(*(c for c in articles.columns if c != name), name)


def audit(articles: DataFrame, key: str, base_url: str = "") -> DataFrame:
    """The findings of with_audit as rows (K4): one scan."""
    return _exploded(with_audit(articles, "_fs", base_url), key, F.col("_fs"))


def cannibalisation(articles: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Whether a post of the index (entry, tokens) already targets the article's keyword."""
    queries = articles.filter("keyword != ''").select(key, T.token_set(F.col("keyword"), L.SITE_STOP).alias("tokens"))
    rows = similarity.best_match(queries, index, key, "entry")
    covered, partial = F.col("status") == "covered", F.col("status") == "partial"
    check = F.when(covered, "duplicate_target").when(partial, "related_post").otherwise("unique")
    impact = F.when(covered, "high").when(partial, "low").otherwise("medium")
    return rows.select(key, F.lit("cannibalisation").alias("group"), check.alias("check"), F.when(covered, "warn").otherwise("pass").alias("status"), impact.alias("impact"))


def page(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, description, headings, images and slug of page rows."""
    title, slug = F.col("title"), html.slug(F.col("url"))
    n, d = F.length(title), F.length("description")
    return _rows(key, (pages, [
        finding("title", "present", F.when(title == "", "fail"), "high"),
        finding("title", "length", F.when(title != "", _either((n < L.TITLE_MIN) | (n > L.TITLE_MAX))), "medium"),
        finding("title", "case", F.when(_capitals(title), "warn"), "low"),
        finding("meta", "present", F.when(F.col("description") == "", "fail"), "high"),
        finding("meta", "length", F.when(F.col("description") != "", _either((d < L.DESCRIPTION_MIN) | (d > L.DESCRIPTION_MAX))), "medium"),
        finding("headings", "h1_count", _either(F.size("h1") > 1, "fail"), F.when(F.size("h1") > 1, "high").otherwise("medium")),
        finding("headings", "structure", F.when(F.size("h2") == 0, "fail"), "high"),
        finding("images", "present", F.when(F.col("images") == 0, "warn"), "low"),
        finding("images", "alt", F.when(F.col("images") > 0, _either(F.col("images_no_alt") > 0)), "medium"),
        finding("technical", "slug_length", _either(F.length(slug) > L.SLUG_MAX), "low"),
        finding("technical", "slug_format", _either(~F.rlike(slug, F.lit("^[a-z0-9-]*$"))), "medium"),
        finding("technical", "schema", _either(F.size("schema_types") == 0), "high"),
    ]))


def _score(lost: Column, of: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 100.0 * (1 - T.rounded(lost, 6) / F.greatest(T.rounded(of, 6), F.lit(1.0))))).cast("long")


def score_of(found: Column) -> Column:
    """roll_up's score of an array of findings, without a shuffle."""
    weight = F.create_map(*(F.lit(x) for kv in IMPACT.items() for x in kv))
    share = F.create_map(*(F.lit(x) for kv in WEIGHT.items() for x in kv))
    total = lambda of: F.aggregate(F.transform(found, of), F.lit(0.0), lambda a, x: a + x)
    return _score(total(lambda f: weight[f["impact"]] * share[f["status"]]), total(lambda f: weight[f["impact"]]))


def roll_up(findings: DataFrame, key: str) -> DataFrame:
    """score, grade, n_pass, n_warn, n_fail of each document: penalties weighted by impact."""
    weight = F.create_map(*(F.lit(x) for kv in IMPACT.items() for x in kv))[F.col("impact")]
    lost = F.create_map(*(F.lit(x) for kv in WEIGHT.items() for x in kv))[F.col("status")]
    sums = findings.groupBy(key).agg(F.sum(weight * lost).alias("_lost"), F.sum(weight).alias("_all"), *(F.sum((F.col("status") == s).cast("long")).alias(f"n_{s}") for s in ("pass", "warn", "fail")))
    score = _score(F.col("_lost"), F.col("_all"))
    rows = sums.withColumn("score", score).drop("_lost", "_all")
    return rows.withColumn("grade", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 55, "needs work").otherwise("poor"))


def group_scores(findings: DataFrame, by: list[str]) -> DataFrame:
    sums = findings.groupBy(*by).agg(*(F.sum((F.col("status") == s).cast("long")).alias(f"n_{s}") for s in ("pass", "warn", "fail")))
    n = F.col("n_pass") + F.col("n_warn") + F.col("n_fail")
    return sums.withColumn("score", T.rounded(100 * (F.col("n_pass") + F.lit(0.55) * F.col("n_warn")) / n, 2))


def quotable(articles: DataFrame) -> DataFrame:
    """How worth citing an article is, 0 to 100: figures and their sources, definitions, steps or lists, answers, years, FAQs.

    articles: text (whole), blocks, faqs.
    """
    t = F.coalesce("text", F.lit(""))
    stats, sourced = F.rlike(t, F.lit(STATISTIC)), F.rlike(t, F.lit(SOURCE))
    steps = F.exists("blocks", lambda b: F.rlike(b["text"], F.lit(BLOCK_STEP)))
    listed = steps | (F.size(F.filter("blocks", lambda b: b["type"] == "li")) >= 3)
    answered = F.exists("blocks", lambda b: b["type"] == "answer")
    asked = F.exists("blocks", lambda b: b["type"].isin("h2", "h3") & T.is_question(b["text"]))
    parts = {"stats": F.when(stats, F.when(sourced, 20).otherwise(10)), "definition": F.when(F.rlike(t, F.lit(DEFINITION)), 15), "listed": F.when(listed, 15), "answers": F.when(answered, 25).when(asked, 8), "year": F.when(F.rlike(t, F.lit(YEAR)), 10), "faqs": F.when(F.size("faqs") > 0, 15)}
    rows = articles.withColumns({f"c_{k}": F.coalesce(v, F.lit(0)).cast("long") for k, v in parts.items()})
    return rows.withColumn("citation", F.least(F.lit(100).cast("long"), sum((F.col(f"c_{k}") for k in parts), F.lit(0))).cast("double"))


def citation(df: DataFrame, text: str = "text") -> DataFrame:
    """How citable a text is, 0 to 100: figures, sources, definitions, steps or lists, years."""
    t = F.col(text)
    stats, sourced = F.rlike(t, F.lit(STATISTIC)), F.rlike(t, F.lit(SOURCE))
    listed = F.rlike(t, F.lit(STEP)) | (T.regex_count(t, "(?m)^[-*] ") >= 3)
    score = F.when(stats, F.when(sourced, 20).otherwise(10)).otherwise(0) + F.when(F.rlike(t, F.lit(DEFINITION)), 15).otherwise(0) + F.when(listed, 15).otherwise(0) + F.when(F.rlike(t, F.lit(YEAR)), 10).otherwise(0)
    return df.withColumns({"citation": score.cast("long"), "has_stats": stats, "sourced": sourced})


def freshness(df: DataFrame, as_of: int, text: str = "text") -> DataFrame:
    """newest: the latest year named; stale where none is of the last two years."""
    years = F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_])(20[0-2][0-9])(?:[^\p{{L}}\p{{N}}_]|$)"), F.lit(1)), lambda y: y.cast("int"))
    rows = df.withColumn("newest", F.array_max(years))
    return rows.withColumn("stale", F.coalesce(F.col("newest") < as_of - 1, F.lit(False)))


def entities(df: DataFrame, key: str, text: str = "text", most: int = 12) -> DataFrame:
    """key, entity, n, k: capitalised phrases named twice or more, the most frequent of each document."""
    from pyspark.sql import Window

    rows = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(1))).alias("pos", "entity"))
    rows = rows.filter(~F.lower("entity").isin("the", "this", "these", "however", "these are"))
    rows = rows.groupBy(key, "entity").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n >= 2")
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return rows.select(key, "entity", "n", k.cast("long").alias("k")).filter(F.col("k") <= most)


def with_terms(df: DataFrame, text: str = "text", most: int = 12, name: str = "terms") -> DataFrame:
    """df with the entities of entities(), of four letters or more and in lower case, as an array: counted within the row, as
    run lengths of the sorted matches, so that nothing is shuffled."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ENTITY), F.lit(1))
    rows = df.withColumn("_m", F.filter(found, lambda e: ~F.lower(e).isin("the", "this", "these", "however", "these are")))
    rows = rows.withColumn("_m", F.array_sort(F.transform("_m", lambda e, i: F.struct(e.alias("e"), i.alias("i")))))
    at = lambda i: F.get("_m", i)
    rows = rows.withColumn("_r", F.filter(F.transform("_m", lambda x, i: F.when((i == 0) | (x["e"] != at(i - 1)["e"]), i)), lambda i: i.isNotNull()))
    runs = F.transform("_r", lambda i, k: F.struct((i - F.coalesce(F.get("_r", k + 1), F.size("_m"))).alias("n"), at(i)["i"].alias("first"), at(i)["e"].alias("e")))
    top = F.slice(F.array_sort(F.filter(runs, lambda r: r["n"] <= -2)), 1, most)
    return rows.withColumn(name, F.transform(F.filter(top, lambda r: F.length(r["e"]) > 3), lambda r: F.lower(r["e"]))).drop("_m", "_r")


def cut(blocks: Column, size: int = 320) -> Column:
    """The chunks (chunk, heading, words, text) of an array of blocks (type, text) in order, cut at headings and once a chunk
    has `size` words: one pass, in which only the open chunk's text grows."""
    counted = F.transform(blocks, lambda b: F.struct(F.coalesce(b["type"].isin("h2", "h3"), F.lit(False)).alias("head"), b["text"].alias("text"), T.word_count(b["text"]).alias("n")))
    none = F.array().cast("array<struct<chunk:int,heading:string,words:bigint,text:string>>")
    start = F.struct(F.lit("").alias("heading"), F.lit(0).alias("words"), F.lit(0).alias("chunk"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("held"), none.alias("out"))

    def closed(a: Column) -> Column:
        one = F.struct(a["chunk"].alias("chunk"), a["heading"].alias("heading"), a["words"].cast("long").alias("words"), F.coalesce(a["text"], F.lit("")).alias("text"))
        return F.when(a["held"], F.concat(a["out"], F.array(one))).otherwise(a["out"])

    def step(a: Column, b: Column) -> Column:
        head, full = b["head"], a["words"] >= size
        return F.struct(
            F.when(head, b["text"]).otherwise(a["heading"]).alias("heading"),
            F.when(head, 0).when(full, b["n"]).otherwise(a["words"] + b["n"]).alias("words"),
            (a["chunk"] + (head | full).cast("int")).alias("chunk"),
            F.when(head, F.lit(None)).when(full | a["text"].isNull(), b["text"]).when(b["text"].isNull(), a["text"]).otherwise(F.concat(a["text"], F.lit(" "), b["text"])).alias("text"),
            (~head).alias("held"),
            F.when(head | full, closed(a)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(counted, start, step, closed)


def _one_each(rows: DataFrame, key: str, cuts: str) -> DataFrame:
    return rows.select(key, F.explode_outer(cuts).alias("_c")).filter("_c is not null").select(key, "_c.*")


def chunks(blocks: DataFrame, key: str, size: int = 320) -> DataFrame:
    """key, chunk, heading, words, text: the chunks of each document's blocks (key, pos, type, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "type", "text")))
    return _one_each(blocks.groupBy(key).agg(ordered.alias("_b")).withColumn("_b", cut(F.col("_b"), size)), key, "_b")


def with_chunks(articles: DataFrame, size: int = 320, name: str = "chunks") -> DataFrame:
    """articles (title, blocks) with their chunks as an array; those before the first heading stand under the title."""
    of = lambda c: F.struct(c["chunk"].alias("chunk"), F.when(c["heading"] == "", F.coalesce("title", F.lit(""))).otherwise(c["heading"]).alias("heading"), c["words"].alias("words"), c["text"].alias("text"))
    return articles.withColumn(name, F.transform(cut(F.col("blocks"), size), of))


def article_chunks(articles: DataFrame, key: str, size: int = 320) -> DataFrame:
    """key, chunk, heading, words, text of articles with title and blocks, without a shuffle."""
    return _one_each(with_chunks(articles, size, "_chunks"), key, "_chunks")


def _readiness() -> Column:
    lost = 55.0 * (F.col("orphans") / F.col("n")) + 30.0 * (F.col("entityless") / F.col("n")) + 15.0 * (F.col("oversized") / F.col("n"))
    return T.rounded(F.greatest(F.lit(0.0), 100.0 - lost), 1)


_OPENS = ORPHAN.replace("(?i)^", rf"(?i)^{T.WS}*", 1)


def article_readiness(articles: DataFrame, size: int = 320) -> DataFrame:
    """articles (title, text, blocks) that have a chunk, with n, orphans, entityless, oversized and readiness as of readiness()
    over their chunks and entities: each article within its row."""
    kept = articles.columns
    rows = with_chunks(with_terms(articles, name="_terms"), size, "_chunks").withColumn("_low", F.transform("_chunks", lambda c: F.lower(F.concat(c["heading"], F.lit(" "), c["text"]))))
    sums = {
        "n": F.size("_chunks"),
        "orphans": F.size(F.filter("_chunks", lambda c: F.rlike(c["text"], F.lit(_OPENS)))),
        "entityless": F.when(F.size("_terms") > 0, F.size(F.filter("_low", lambda t: ~F.exists("_terms", lambda e: F.contains(t, e))))).otherwise(0),
        "oversized": F.size(F.filter("_chunks", lambda c: c["words"] > size * 1.6)),
    }
    # behind an explode_outer a filter stays where it is; pushed below, all the above would be computed for it once more
    rows = rows.select(*kept, F.explode_outer(F.array(F.struct(*(v.cast("long").alias(k) for k, v in sums.items())))).alias("_s")).select(*kept, "_s.*")
    return rows.filter("n > 0").withColumn("readiness", _readiness())


def readiness(chunked: DataFrame, key: str, named: DataFrame | None = None, size: int = 320) -> DataFrame:
    """Of each document's chunks the shares that open with a dangling reference, name none of its entities (named: key,
    entity) or are too long, and the score of all three. Documents without entities lose nothing by them."""
    rows = chunked.withColumns({"_orphan": F.rlike("text", F.lit(_OPENS)), "_large": F.col("words") > size * 1.6})
    if named is None:
        rows = rows.withColumn("_less", F.lit(False))
    else:
        terms = named.filter(F.length("entity") > 3).groupBy(key).agg(F.collect_list(F.lower("entity")).alias("_terms"))  # a dozen at most
        low = F.lower(F.concat("heading", F.lit(" "), "text"))
        rows = rows.join(terms, key, "left").withColumn("_less", F.coalesce(~F.exists("_terms", lambda e: F.contains(low, e)), F.lit(False)))
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(n) for c, n in (("_orphan", "orphans"), ("_less", "entityless"), ("_large", "oversized"))))
    return sums.withColumn("readiness", _readiness())


def reach(df: DataFrame, blocked: str = "blocked", manifest: str = "manifest") -> DataFrame:
    """geo: what answer engines can make of a page, of readiness, citation and an llms.txt; little where their crawlers are shut out.

    blocked: whether a crawler is, null where nothing is known of the site.
    """
    total = T.rounded(0.45 * F.col("readiness") + 0.40 * F.col("citation") + 0.15 * F.when(F.col(manifest), 100.0).otherwise(0.0), 1)
    return df.withColumns({"geo": F.when(F.col(blocked), T.rounded(total * 0.4, 1)).otherwise(total), "gated": F.coalesce(F.col(blocked), F.lit(False))})


def headed(chunked: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Chunks before the first heading stand under the title (titles: key, title)."""
    rows = chunked.join(titles.select(key, F.col("title").alias("_title")), key, "left")
    return rows.withColumn("heading", F.when(F.col("heading") == "", F.coalesce("_title", F.lit(""))).otherwise(F.col("heading"))).drop("_title")


def keyword_placement(df: DataFrame, key: str, body: str = "body", keyword: str = "keyword", slug: str = "slug") -> DataFrame:
    """Density, place in the first hundred words and in the slug, of each document's keyword; a warning where there is none."""
    kw, low = F.col(keyword), F.lower(F.coalesce(F.col(body), F.lit("")))
    rows = df.withColumns({"_low": low, "_has": kw != ""})
    hits = (F.length("_low") - F.length(F.replace("_low", kw, F.lit("")))) / F.greatest(F.length(kw), F.lit(1))
    rows = rows.withColumn("_density", F.when(F.col("_has"), T.rounded(hits / F.greatest(F.lit(1), T.word_count(F.col("_low"))) * 100.0, 2)))
    density, has = F.col("_density"), F.col("_has")
    first = F.array_join(F.slice(T.tokens(F.col("_low")), 1, 100), " ")
    status = F.when((density == 0) | (density > 3.0), "fail").when((density > 2.0) | (density < 0.3), "warn").otherwise("pass")
    impact = F.when(F.col("_density").isNull(), "medium").when((density == 0) | (density > 3.0), "high").when(density > 2.0, "medium").when(density < 0.3, "low").otherwise("medium")
    dashed = F.replace(kw, F.lit(" "), F.lit("-"))
    return _rows(key, (rows, [
        finding("keywords", "detected", F.when(~has, "warn"), "medium"),
        finding("keywords", "density", F.when(has, status), impact),
        finding("keywords", "first_paragraph", F.when(has, _either(~F.contains(first, kw))), "medium"),
        finding("keywords", "url", F.when(has & (F.col(slug) != "") & ~F.contains(F.lower(F.col(slug)), dashed), "warn"), "medium"),
    ]))
