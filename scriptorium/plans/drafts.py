"""Queries on article rows made of documents, which reach every branch of the checks, and on edited pairs of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import answers, articles, compare, findings, integrity, keywords, scoring
from ..session import scratch_folder, spread, table
from ..sources import html
from . import sql as S
from .catalog import documents, query

KINDS = ["h2", "answer", "p", "p", "li", "h3", "p", "tldr"]
STUDY = "According to a study in 2024, 50 percent of patients recover. Consult a doctor about the treatment."
CLAIM = "This is a guaranteed cure with 100% success for every disease."
STEPS = ["First step of three", "Second step", "Then the third"]


def draft_articles(spark: SparkSession, d: str) -> DataFrame:
    """An article for each document: its first line is the title, its last one the description, the others are blocks whose
    kinds take turns; author, dates, slug, images, links, FAQs and types follow from the id."""
    i = F.col("doc_id")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.clean), lambda x: x != "")
    rows = spread(documents(spark, d).select("doc_id", "text")).select("doc_id", lines.alias("_l"))
    head = F.trim(F.substring(F.coalesce(F.get("_l", F.lit(0)), F.lit("")), F.lit(1), (20 + i % 60).cast("int")))
    title = F.when(i % 23 == 0, "").when(i % 17 == 0, F.translate(head, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(head)
    last = F.coalesce(F.get("_l", F.size("_l") - 1), F.lit(""))
    about = F.when(i % 19 == 0, "").otherwise(F.trim(F.concat(F.when(i % 2 == 0, "Learn: ").otherwise(""), F.substring(last, F.lit(1), (40 + i % 150).cast("int")))))
    kinds = F.array(*map(F.lit, KINDS))

    def block(x, n):
        kind = F.element_at(kinds, ((n + i) % 8 + 1).cast("int"))
        text = F.when(~kind.isin("h2", "h3"), x).when(n % 2 == 0, F.concat(F.lit("What is "), F.substring(x, 1, 40), F.lit("?"))).otherwise(F.substring(x, 1, 80))
        return F.struct(kind.alias("type"), text.alias("text"))

    kind = "array<struct<type:string,text:string>>"
    of = lambda k, t: F.struct(F.lit(k).alias("type"), F.lit(t).alias("text"))
    more = F.concat(F.when(i % 3 == 0, F.array(of("p", STUDY))).when(i % 3 == 1, F.array(of("p", CLAIM))).otherwise(F.array().cast(kind)), F.when(i % 5 == 0, F.array(*(of("li", s) for s in STEPS))).otherwise(F.array().cast(kind)))
    slug = F.when(i % 5 == 0, "").when(i % 5 == 1, "Some_Slug").when(i % 5 == 2, "caf%C3%A9").otherwise(F.concat(F.lit("a-"), F.repeat(F.lit("x"), (i % 90).cast("int"))))
    none = lambda t: F.array().cast(f"array<struct<{t}>>")
    image = lambda src, alt: F.struct(F.lit(src).alias("src"), alt.alias("alt"))
    plain, named = image("/img_1.jpg", F.lit("")), image("/a/kidney-chart.png", title)
    link = lambda h, t: F.array(F.struct(F.lit(h).alias("href"), F.lit(t).alias("text")))
    faq = lambda n: F.struct(F.concat(F.lit("Question "), n.cast("string"), F.lit("?")).alias("q"), F.concat(F.lit("Answer "), n.cast("string"), F.lit(".")).alias("a"))
    return rows.select(
        "doc_id",
        title.alias("title"),
        about.alias("meta_description"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, "Anna Writer").otherwise("Desk").alias("author"),
        F.when(i % 2 == 0, "").otherwise("MD").alias("author_credentials"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("2026-01-0"), (1 + i % 9).cast("string"))).alias("published"),
        slug.alias("slug"),
        F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("https://www.example.com/"), slug)).alias("source_url"),
        F.concat(F.transform(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), block), more).alias("blocks"),
        F.when(i % 4 == 0, none("src:string,alt:string")).when(i % 4 == 1, F.array(plain)).when(i % 4 == 2, F.array(named)).otherwise(F.array(plain, named)).alias("images"),
        F.when(i % 5 == 0, none("href:string,text:string")).when(i % 5 == 1, F.concat(link("/a", "here"), link("https://other.org/x", "good words"))).when(i % 5 == 2, link("https://www.example.com/b", " Read more ")).when(i % 5 == 3, link("mailto:x@y.org", "mail")).otherwise(link("http://other.org/y", "this")).alias("links"),
        F.when(i % 8 == 0, none("q:string,a:string")).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(i % 8, F.lit(1))), faq)).alias("faqs"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("Article"))).when(i % 4 == 2, F.array(*map(F.lit, ("Article", "BreadcrumbList", "FAQPage")))).otherwise(F.array(*map(F.lit, ("BreadcrumbList", "MedicalWebPage")))).alias("schema_types"),
    ).withColumn("text", articles.full_text())


def _struct(**of: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in of.items()) + "}"


def _q(t: str) -> str:
    return S.quoted(t)


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ARTICLES = f"""WITH d0 AS (SELECT doc_id, doc_id AS i, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {S.clean("x")}), lambda x: x <> '') AS l FROM documents),
d1 AS (SELECT *, trim(left(coalesce(l[1], ''), 20 + (i % 60)::INT), ' ') AS head, coalesce(l[len(l)], '') AS last FROM d0),
d2 AS (SELECT *, CASE WHEN i % 23 = 0 THEN '' WHEN i % 17 = 0 THEN translate(head, '{_LOWER}', '{_UPPER}') ELSE head END AS title,
    CASE WHEN i % 19 = 0 THEN '' ELSE trim(CASE WHEN i % 2 = 0 THEN 'Learn: ' ELSE '' END || left(last, 40 + (i % 150)::INT), ' ') END AS about,
    CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN 'Some_Slug' WHEN 2 THEN 'caf%C3%A9' ELSE 'a-' || repeat('x', (i % 90)::INT) END AS slug,
    list_concat(list_transform(l[2:], lambda x, n: {_struct(type=f"{S.names(KINDS)}[((n - 1 + i) % 8 + 1)::INT]", text=f"CASE WHEN {S.names(KINDS)}[((n - 1 + i) % 8 + 1)::INT] NOT IN ('h2', 'h3') THEN x WHEN (n - 1) % 2 = 0 THEN 'What is ' || left(x, 40) || '?' ELSE left(x, 80) END")}),
        list_concat(CASE i % 3 WHEN 0 THEN [{_struct(type="'p'", text=_q(STUDY))}] WHEN 1 THEN [{_struct(type="'p'", text=_q(CLAIM))}] ELSE [] END, CASE WHEN i % 5 = 0 THEN [{", ".join(_struct(type="'li'", text=_q(s)) for s in STEPS)}] ELSE [] END)) AS blocks FROM d1),
art AS (SELECT doc_id, i, title, about, CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'Anna Writer' ELSE 'Desk' END AS author, CASE WHEN i % 2 = 0 THEN '' ELSE 'MD' END AS credentials,
    CASE WHEN i % 4 = 0 THEN '' ELSE '2026-01-0' || (1 + i % 9) END AS published, slug, CASE WHEN i % 6 = 0 THEN '' ELSE 'https://www.example.com/' || slug END AS source_url, blocks,
    CASE i % 4 WHEN 0 THEN [] WHEN 1 THEN [{_struct(src="'/img_1.jpg'", alt="''")}] WHEN 2 THEN [{_struct(src="'/a/kidney-chart.png'", alt="title")}] ELSE [{_struct(src="'/img_1.jpg'", alt="''")}, {_struct(src="'/a/kidney-chart.png'", alt="title")}] END AS images,
    CASE i % 5 WHEN 0 THEN [] WHEN 1 THEN [{_struct(href="'/a'", text="'here'")}, {_struct(href="'https://other.org/x'", text="'good words'")}] WHEN 2 THEN [{_struct(href="'https://www.example.com/b'", text="' Read more '")}] WHEN 3 THEN [{_struct(href="'mailto:x@y.org'", text="'mail'")}] ELSE [{_struct(href="'http://other.org/y'", text="'this'")}] END AS links,
    (i % 8)::INT AS faqs, CASE i % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Article'] WHEN 2 THEN ['Article', 'BreadcrumbList', 'FAQPage'] ELSE ['BreadcrumbList', 'MedicalWebPage'] END AS types,
    list_transform(list_filter(blocks, lambda b: b.type IN ('h2', 'h3')), lambda b: b.text) AS heads,
    array_to_string(list_filter(list_transform(blocks, lambda b: b.text), lambda x: {S.strip("x")} <> ''), chr(10) || chr(10)) AS body FROM d2),
kt AS (SELECT *, title || chr(10) || chr(10) || body AS text, lower(body) AS low, list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({S.names(L.AUDIT_STOP)}, w)) AS ts FROM art),
kn AS (SELECT *, list_filter(list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2]), lambda q: (length(low) - length(replace(low, q, ''))) // length(q) >= 2) AS tri,
    list_filter(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]), lambda q: (length(low) - length(replace(low, q, ''))) // length(q) >= 2) AS bi, list_transform(ts, lambda w: (length(low) - length(replace(low, w, ''))) // length(w)) AS cs FROM kt),
a AS (SELECT * EXCLUDE (tri, bi, cs, ts, low), coalesce(tri[1], bi[1], CASE WHEN len(ts) > 0 THEN ts[list_position(cs, list_max(cs))] END, '') AS kw FROM kn)"""


def with_keyword(spark: SparkSession, d: str) -> DataFrame:
    return articles.keyword(draft_articles(spark, d))


def _find(group: str, check: str, status: str, impact: str = "'medium'", where: str = "true", source: str = "a") -> str:
    return f"SELECT doc_id, '{group}' AS \"group\", '{check}' AS \"check\", {status} AS status, {impact} AS impact FROM {source} WHERE {where}"


def _warn(bad: str, worse: str = "warn") -> str:
    return f"CASE WHEN {bad} THEN '{worse}' ELSE 'pass' END"


def _rx(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {S.quoted(pattern)})"


_CAPS = r"regexp_matches(title, '\p{Lu}') AND NOT regexp_matches(title, '[\p{Ll}\p{Lt}]')"
_AT = "strpos(lower(title), kw)"
TITLE = " UNION ALL ".join(
    [
        _find("title", "present", "'fail'", "'high'", "title = ''"),
        _find("title", "length", _warn("length(title) < 30 OR length(title) > 60"), where="title <> ''"),
        _find("title", "keyword", f"CASE WHEN {_AT} = 0 THEN 'fail' ELSE 'pass' END", "'high'", f"title <> '' AND kw <> '' AND {_AT} <= 36"),
        _find("title", "keyword_position", "'warn'", where=f"title <> '' AND kw <> '' AND {_AT} > 36"),
        _find("title", "case", "'warn'", "'low'", _CAPS),
    ]
)
META = " UNION ALL ".join(
    [
        _find("meta", "present", "'fail'", "'high'", "about = ''"),
        _find("meta", "length", _warn("length(about) < 70 OR length(about) > 155"), where="about <> ''"),
        _find("meta", "keyword", _warn("NOT contains(lower(about), kw)"), where="about <> '' AND kw <> ''"),
        _find("meta", "cta", "'warn'", "'low'", f"about <> '' AND NOT {_rx('about', '(?i)(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(' + '|'.join(L.CALLS) + ')([^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')}"),
    ]
)
#: Questions as a line of English words opens them, or with a question mark; the drafts hold no Hindi.
QUESTION = r"(?im)[?？]|^(what|why|how|when|where|which|who|can|is|are|does|do|should|will)([^\p{L}\p{N}_]|$)"
_ASKED = f"len(list_filter(heads, lambda h: regexp_matches({S.strip('h')}, {S.quoted(QUESTION)})))"
_HITS = "len(list_filter(heads, lambda h: contains(lower(h), kw)))"
_LEVELS = "list_filter(list_transform(blocks, lambda b: b.type), lambda k: k IN ('h2', 'h3'))"
_SKIP = f"list_contains({_LEVELS}, 'h3') AND (NOT list_contains({_LEVELS}, 'h2') OR list_position({_LEVELS}, 'h3') < list_position({_LEVELS}, 'h2'))"
HEADINGS = " UNION ALL ".join(
    [
        _find("headings", "h1_count", "'pass'"),
        _find("headings", "structure", "'fail'", "'high'", "len(heads) = 0"),
        _find("headings", "hierarchy", _warn(_SKIP), where="len(heads) > 0"),
        _find("headings", "keyword", _warn(f"{_HITS} = 0"), where=f"len(heads) > 0 AND kw <> '' AND NOT ({_HITS} > 0 AND {_HITS} > greatest(2, len(heads) // 2))"),
        _find("headings", "keyword_stuffing", "'warn'", where=f"len(heads) > 0 AND kw <> '' AND {_HITS} > greatest(2, len(heads) // 2)"),
        _find("headings", "questions", _warn(f"{_ASKED} / len(heads) < 0.3"), where="len(heads) > 0"),
        _find("headings", "length", "'warn'", "'low'", "len(list_filter(heads, lambda h: length(h) > 70)) > 0"),
    ]
)
_OWN = S.host("source_url")
_IN = f"(starts_with(x.href, '/') OR ({_OWN} <> '' AND {S.host('x.href')} = {_OWN}))"
_EXTERNAL = f"len(list_filter(links, lambda x: starts_with(x.href, 'http') AND NOT {_IN})) > 0"
LINKS = " UNION ALL ".join(
    [
        _find("links", "internal", _warn(f"len(list_filter(links, lambda x: {_IN})) = 0")),
        _find("links", "external", _warn(f"NOT ({_EXTERNAL})"), f"CASE WHEN {_EXTERNAL} THEN 'low' ELSE 'medium' END"),
        _find("links", "anchor_text", "'warn'", where=f"len(list_filter(links, lambda x: lower({S.strip('x.text')}) IN ({', '.join(map(S.quoted, articles.GENERIC_ANCHORS))}))) > 0"),
    ]
)
IMAGES = " UNION ALL ".join(
    [
        _find("images", "present", "'warn'", where="len(images) = 0"),
        _find("images", "alt", _warn(f"len(list_filter(images, lambda x: {S.strip('x.alt')} = '')) > 0", "fail"), "'high'", "len(images) > 0"),
        _find("images", "alt_keyword", "'warn'", "'low'", "len(images) > 0 AND kw <> '' AND len(list_filter(images, lambda x: contains(lower(x.alt), kw))) = 0"),
        _find("images", "filename", "'warn'", "'low'", "len(list_filter(images, lambda x: regexp_matches(x.src, '(?i)/(img|image|photo|dsc|screenshot)[-_]?[0-9]*\\.[A-Za-z0-9_]+$'))) > 0"),
    ]
)
_ODD = r"(contains(slug, '_') OR regexp_matches(slug, '[\p{Lu}\p{Lt}]'))"
_WHOLE = "(list_has_any(types, ['Article', 'MedicalWebPage']) AND (faqs = 0 OR list_contains(types, 'FAQPage')) AND list_contains(types, 'BreadcrumbList'))"
TECHNICAL = " UNION ALL ".join(
    [
        _find("technical", "slug", "CASE WHEN slug = '' THEN 'warn' ELSE 'pass' END", where=f"slug = '' OR (length(slug) <= 75 AND NOT {_ODD})"),
        _find("technical", "slug_length", "'warn'", "'low'", "length(slug) > 75"),
        _find("technical", "slug_format", "'warn'", "'low'", f"slug <> '' AND {_ODD}"),
        _find("technical", "slug_encoding", "'warn'", where="regexp_matches(slug, '%[0-9A-Fa-f]{2}')"),
        _find("technical", "schema", "CASE WHEN len(types) = 0 THEN 'fail' ELSE 'pass' END", "'high'", f"len(types) = 0 OR {_WHOLE}"),
        _find("technical", "schema_types", "'warn'", where=f"len(types) > 0 AND NOT {_WHOLE}"),
        _find("technical", "canonical", _warn("source_url = ''")),
    ]
)
_QH = f"list_filter(heads, lambda h: regexp_matches({S.strip('h')}, {S.quoted(QUESTION)}))"
_GOOD = f"len(list_filter(blocks, lambda b: b.type = 'answer' AND {S.wc('b.text')} BETWEEN 30 AND 75))"
_TITLED, _ABOUT = "length(title) > 10 AND length(title) <= 60", "length(about) > 50 AND length(about) <= 155"
AEO = f"""ae0 AS (SELECT *, CASE WHEN len(heads) > 0 THEN len({_QH}) / len(heads) ELSE 0.0 END::DOUBLE AS qr, len({_QH}) AS nq, CASE WHEN len({_QH}) > 0 THEN {_GOOD} / len({_QH}) ELSE 0.0 END::DOUBLE AS ar,
    len(list_filter(blocks, lambda b: b.type = 'tldr')) > 0 AS tldr, len(list_intersect(types, ['Article', 'FAQPage', 'BreadcrumbList'])) AS nt FROM a),
ae AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.22::DOUBLE * {S.norm("qr", 0.6, 0.0)} + 0.18::DOUBLE * {S.norm("faqs", 6.0, 0.0)} + 0.15::DOUBLE * CASE WHEN tldr THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END + 0.20::DOUBLE * {S.norm("ar", 0.85, 0.0)}
    + 0.10::DOUBLE * CASE WHEN {_TITLED} THEN 100.0::DOUBLE ELSE 40.0::DOUBLE END + 0.05::DOUBLE * CASE WHEN {_ABOUT} THEN 100.0::DOUBLE ELSE 40.0::DOUBLE END + 0.10::DOUBLE * {S.norm("nt", 3.0, 0.0)})), 1) AS aeo FROM ae0)"""
ANSWERS = " UNION ALL ".join(
    [
        _find("aeo", "score", "CASE WHEN aeo >= 70 THEN 'pass' WHEN aeo >= 45 THEN 'warn' ELSE 'fail' END", "'high'", source="ae"),
        *(
            _find("aeo", check, "'warn'", where=when, source="ae")
            for check, when in (("question_headings", "qr < 0.4"), ("faq_count", "faqs < 6"), ("tldr", "NOT tldr"), ("answer_blocks", "nq > 0 AND ar < 0.7"), ("meta_title", f"NOT ({_TITLED})"), ("meta_description", f"NOT ({_ABOUT})"), ("schema", "nt < 3"))
        ),
    ]
)
_HAS = lambda words: "(" + " OR ".join(f"contains(lower(text), {S.quoted(w)})" for w in words) + ")"
_ADVISED = _rx("lower(text)", "(^|[^" + chr(92) + "p{L}" + chr(92) + "p{N}_])(" + "|".join(L.ADVICE) + ")([^" + chr(92) + "p{L}" + chr(92) + "p{N}_]|$)")
TRUST = " UNION ALL ".join(
    [
        _find("eeat", "author", _warn("author = ''")),
        _find("eeat", "date", _warn("published = ''"), "CASE WHEN published = '' THEN 'medium' ELSE 'low' END"),
        _find("eeat", "medical_disclaimer", _warn(f"NOT {_ADVISED}", "fail"), "'high'", _HAS(L.HEALTH)),
        _find("eeat", "credentials", "'warn'", "'high'", f"{_HAS(L.HEALTH)} AND credentials = ''"),
        _find("eeat", "overclaim", "'fail'", "'high'", f"{_HAS(L.HEALTH)} AND {_HAS(L.OVERCLAIMS)}"),
    ]
)


@query(f"{ARTICLES} {TITLE}")
def e16_title_findings(spark, d):
    return findings.title(with_keyword(spark, d), "doc_id")


@query(f"{ARTICLES} {META}")
def e17_meta_findings(spark, d):
    return findings.description(with_keyword(spark, d), "doc_id")


@query(f"{ARTICLES} {HEADINGS}")
def e18_heading_findings(spark, d):
    return findings.headings(with_keyword(spark, d), "doc_id")


@query(f"{ARTICLES} {LINKS}")
def e21_link_findings(spark, d):
    return findings.links(draft_articles(spark, d), "doc_id")


@query(f"{ARTICLES} {IMAGES}")
def e22_image_findings(spark, d):
    return findings.images(with_keyword(spark, d), "doc_id")


@query(f"{ARTICLES} {TECHNICAL}")
def e23_technical_findings(spark, d):
    return findings.technical(draft_articles(spark, d), "doc_id")


@query(f"{ARTICLES}, {AEO} {ANSWERS}")
def e24_answer_findings(spark, d):
    return findings.answers(articles.structure(draft_articles(spark, d)), "doc_id")


@query(f"{ARTICLES} {TRUST}")
def e25_trust_findings(spark, d):
    return findings.trust(draft_articles(spark, d), "doc_id")


_ALL = " UNION ALL ".join((TITLE, META, HEADINGS, LINKS, IMAGES, TECHNICAL, ANSWERS, TRUST))


@query(
    f"""{ARTICLES}, {AEO}, fs AS ({_ALL}), g AS (SELECT doc_id, sum(CASE impact WHEN 'high' THEN 1.6 WHEN 'medium' THEN 1.0 ELSE 0.5 END * CASE status WHEN 'fail' THEN 1.0 WHEN 'warn' THEN 0.45 ELSE 0 END)::DOUBLE AS lost,
sum(CASE impact WHEN 'high' THEN 1.6 WHEN 'medium' THEN 1.0 ELSE 0.5 END)::DOUBLE AS al, count(*) FILTER (status = 'pass')::BIGINT AS n_pass, count(*) FILTER (status = 'warn')::BIGINT AS n_warn, count(*) FILTER (status = 'fail')::BIGINT AS n_fail FROM fs GROUP BY doc_id),
h AS (SELECT *, round(greatest(0.0::DOUBLE, 100.0::DOUBLE * (1 - round(lost, 6) / greatest(round(al, 6), 1.0::DOUBLE))))::BIGINT AS score FROM g)
SELECT doc_id, n_pass, n_warn, n_fail, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 55 THEN 'needs work' ELSE 'poor' END AS grade FROM h"""
)
def e15_k4_audit(spark, d):
    return findings.roll_up(findings.audit(with_keyword(spark, d), "doc_id"), "doc_id")


_STEPPED = f"len(list_filter(blocks, lambda b: regexp_matches(b.text, {S.quoted(findings.BLOCK_STEP)}))) > 0"
QUOTABLE = f"""qc AS (SELECT *, least(100, CASE WHEN {_rx("text", findings.STATISTIC)} THEN CASE WHEN {_rx("text", findings.SOURCE)} THEN 20 ELSE 10 END ELSE 0 END + CASE WHEN {_rx("text", findings.DEFINITION)} THEN 15 ELSE 0 END
    + CASE WHEN {_STEPPED} OR len(list_filter(blocks, lambda b: b.type = 'li')) >= 3 THEN 15 ELSE 0 END + CASE WHEN len(list_filter(blocks, lambda b: b.type = 'answer')) > 0 THEN 25 WHEN len({_QH}) > 0 THEN 8 ELSE 0 END
    + CASE WHEN {_rx("text", findings.YEAR)} THEN 10 ELSE 0 END + CASE WHEN faqs > 0 THEN 15 ELSE 0 END)::DOUBLE AS citation FROM a)"""


@query(f"{ARTICLES}, {QUOTABLE} SELECT doc_id, citation FROM qc")
def e26_quotable(spark, d):
    return findings.quotable(draft_articles(spark, d)).select("doc_id", "citation")


# a document's blocks are reduced in order: the running words, the number of the chunk, and each block's chunk
_ELEMENT = f"{{'h': b.type IN ('h2', 'h3'), 'n': {S.wc('b.text')}, 'w': 0, 'c': 0, 'cs': []::INT[]}}"
_START = "[{'h': false, 'n': 0, 'w': 0, 'c': 0, 'cs': []::INT[]}]"
_FRESH = "(y.h OR x.w >= 320)"
CHUNKS = f"""ch0 AS (SELECT doc_id, title, blocks, list_reduce(list_concat({_START}, list_transform(blocks, lambda b: {_ELEMENT})),
    lambda x, y: {{'h': y.h, 'n': y.n, 'w': CASE WHEN y.h THEN 0 WHEN {_FRESH} THEN y.n ELSE x.w + y.n END, 'c': x.c + CASE WHEN {_FRESH} THEN 1 ELSE 0 END, 'cs': list_append(x.cs, x.c + CASE WHEN {_FRESH} THEN 1 ELSE 0 END)}}).cs AS cs FROM a),
ch1 AS (SELECT doc_id, title, unnest(blocks).type AS type, unnest(blocks).text AS text, unnest(cs) AS chunk, generate_subscripts(blocks, 1) AS pos FROM ch0),
ch2 AS (SELECT *, last_value(CASE WHEN type IN ('h2', 'h3') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM ch1),
ch AS (SELECT doc_id, chunk, coalesce(max(heading), any_value(title)) AS heading, sum({S.wc("text")})::BIGINT AS words, string_agg(text, ' ' ORDER BY pos) AS text FROM ch2 WHERE type NOT IN ('h2', 'h3') GROUP BY doc_id, chunk)"""


def draft_chunks(rows: DataFrame) -> DataFrame:
    return findings.article_chunks(rows, "doc_id")


@query(f"{ARTICLES}, {CHUNKS} SELECT doc_id, chunk, heading, words, md5(text) AS digest FROM ch")
def i3_draft_chunks(spark, d):
    return draft_chunks(draft_articles(spark, d)).select("doc_id", "chunk", "heading", F.col("words").cast("long").alias("words"), F.md5("text").alias("digest"))


ENTITIES = f"""en0 AS (SELECT doc_id, regexp_extract_all(text, {S.quoted(findings.ENTITY)}, 1) AS es FROM a), en1 AS (SELECT doc_id, unnest(es) AS entity, generate_subscripts(es, 1) AS pos FROM en0),
en2 AS (SELECT doc_id, entity, count(*)::BIGINT AS n, min(pos) AS first FROM en1 WHERE lower(entity) NOT IN ('the', 'this', 'these', 'however', 'these are') GROUP BY ALL HAVING count(*) >= 2),
en AS (SELECT doc_id, entity, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::BIGINT AS k FROM en2 QUALIFY k <= 12)"""
_ORPHAN = rf"(?i)^{S.WS}*" + findings.ORPHAN.replace("(?i)^", "")
READY = f"""et AS (SELECT doc_id, list(lower(entity)) AS terms FROM en WHERE length(entity) > 3 GROUP BY doc_id),
rd0 AS (SELECT ch.*, {_rx("text", _ORPHAN)} AS orphan, coalesce(len(list_filter(terms, lambda e: contains(lower(heading || ' ' || text), e))) = 0, false) AS less, words > 512 AS large FROM ch LEFT JOIN et USING (doc_id)),
rd AS (SELECT doc_id, count(*)::BIGINT AS n, sum(orphan::INT)::BIGINT AS orphans, sum(less::INT)::BIGINT AS entityless, sum(large::INT)::BIGINT AS oversized FROM rd0 GROUP BY doc_id),
re AS (SELECT *, round(greatest(0.0::DOUBLE, 100.0::DOUBLE - (55.0::DOUBLE * (orphans / n) + 30.0::DOUBLE * (entityless / n) + 15.0::DOUBLE * (oversized / n))), 1) AS readiness FROM rd)"""


def draft_readiness(rows: DataFrame) -> DataFrame:
    return findings.article_readiness(rows).select("doc_id", "n", "orphans", "entityless", "oversized", "readiness")


@query(f"{ARTICLES}, {CHUNKS}, {ENTITIES}, {READY} SELECT doc_id, n, orphans, entityless, oversized, readiness FROM re")
def e27_readiness(spark, d):
    return draft_readiness(draft_articles(spark, d))


@query(
    f"""{ARTICLES}, {CHUNKS}, {ENTITIES}, {READY}, {QUOTABLE}, ge AS (SELECT doc_id, round(0.45::DOUBLE * readiness + 0.40::DOUBLE * citation + 0.15::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END, 1) AS total, CASE WHEN doc_id % 7 > 0 THEN doc_id % 5 = 0 END AS blocked FROM re JOIN qc USING (doc_id))
SELECT doc_id, CASE WHEN blocked THEN round(total * 0.4::DOUBLE, 1) ELSE total END AS geo, coalesce(blocked, false) AS gated FROM ge"""
)
def e29_reach(spark, d):
    """Whether the site has an llms.txt and shuts crawlers out follows from the id here."""
    joined = findings.quotable(findings.article_readiness(draft_articles(spark, d)))
    i = F.col("doc_id")
    joined = joined.withColumns({"manifest": i % 2 == 0, "blocked": F.when(i % 7 > 0, i % 5 == 0)})
    return findings.reach(joined).select("doc_id", "geo", "gated")


# ---------------------------------------------------------------- rendering and structure

_TLDR = "list_filter(list_transform(['  First point ', '', 'Second point'], lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(
    f"""{ARTICLES}, p AS (SELECT doc_id, list_concat([{_struct(type="'h2'", text="'In short'")}], list_concat(list_transform({_TLDR}, lambda x: {_struct(type="'tldr'", text="x")}),
flatten(list_transform(blocks, lambda b: CASE WHEN b.type IN ('h2', 'h3') AND b.text = heads[1] THEN [{_struct(type="b.type", text="b.text")}, {_struct(type="'answer'", text="'Because.'")}] ELSE [{_struct(type="b.type", text="b.text")}] END)))) AS bs, blocks, i, title FROM a)
SELECT doc_id, CASE WHEN i % 2 = 0 THEN trim('Planned ' || title, ' ') ELSE title END AS title, md5(array_to_string(list_transform(CASE WHEN i % 2 = 0 THEN bs ELSE blocks END, lambda b: b.type || ':' || b.text), '|')) AS digest FROM p"""
)
def n5_g11_structured(spark, d):
    """Plans for every other article: a summary, and an answer to its first heading."""
    rows = draft_articles(spark, d)
    heads = F.transform(F.filter("blocks", lambda b: b["type"].isin("h2", "h3")), lambda b: b["text"])
    none = "cast(null as {}) as {}"
    plans = rows.filter("doc_id % 2 = 0").withColumn("_h", F.get(heads, F.lit(0)))
    plans = plans.select("doc_id", F.concat(F.lit("Planned "), "title").alias("title"), F.expr(none.format("string", "meta_description")), F.array(F.lit("  First point "), F.lit(""), F.lit("Second point")).alias("tldr"), F.lit("In short").alias("tldr_heading"), F.when(F.col("_h").isNotNull(), F.create_map(F.col("_h"), F.lit(" Because. "))).alias("answers"), F.expr(none.format("array<struct<type:string,text:string>>", "blocks")), F.expr(none.format("array<struct<q:string,a:string>>", "faqs")), F.expr(none.format("map<string,string>", "images_alt")))
    out = answers.apply_structure(rows, plans, "doc_id")
    return out.select("doc_id", "title", F.md5(F.array_join(F.transform("blocks", lambda b: F.concat(b["type"], F.lit(":"), b["text"])), "|")).alias("digest"))


_ISLI = "(b.type IN ('li', 'tldr'))"
_NEXT = "coalesce(list_extract(blocks, n + 1).type IN ('li', 'tldr'), false)"


@query(
    f"""{ARTICLES}, m AS (SELECT doc_id, array_to_string(list_filter(list_concat(['# ' || title || chr(10), CASE WHEN about <> '' THEN '> ' || about || chr(10) END], list_concat(list_transform(blocks, lambda b, n:
CASE WHEN {_ISLI} THEN '- ' || b.text || CASE WHEN NOT ({_NEXT} AND (list_extract(blocks, n + 1).type IN ('li', 'tldr'))) THEN chr(10) ELSE '' END WHEN b.type = 'h2' THEN '## ' || b.text || chr(10) WHEN b.type = 'h3' THEN '### ' || b.text || chr(10) WHEN b.type = 'answer' THEN '**' || b.text || '**' || chr(10) WHEN b.type = 'quote' THEN '> ' || b.text || chr(10) ELSE b.text || chr(10) END),
[CASE WHEN faqs > 0 THEN chr(10) || '## FAQ' || chr(10) || chr(10) || array_to_string(list_transform(range(1, faqs + 1), lambda k: '### Question ' || k || '?' || chr(10) || chr(10) || 'Answer ' || k || '.' || chr(10)), chr(10)) END])), lambda x: x IS NOT NULL), chr(10)) || chr(10) AS md FROM a)
SELECT doc_id, length(md)::BIGINT AS n_chars, md5(md) AS digest FROM m"""
)
def b15_o9_markdown(spark, d):
    out = answers.render_markdown(draft_articles(spark, d))
    return out.select("doc_id", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("digest"))


@query(f"{ARTICLES} SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, (length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]')))::BIGINT AS units FROM a")
def b16_c25_escaped(spark, d):
    rows = draft_articles(spark, d)
    return rows.select("doc_id", T.escape_html(F.col("text")).alias("escaped"), T.utf16_length(F.col("text")).cast("long").alias("units"))


# ---------------------------------------------------------------- competitors: eight articles that follow each other are a group

_HEADS = "hh AS (SELECT doc_id // 8 AS grp, doc_id, doc_id % 8 = 0 AS mine, unnest(heads) AS heading, generate_subscripts(heads, 1) AS n FROM a), h AS (SELECT *, doc_id * 1000 + n AS seq, " + S.token_set("heading", L.AUDIT_STOP, 3) + " AS ts FROM hh)"
_ALIKE = "len(x.ts) > 0 AND len(y.ts) > 0 AND 2 * len(list_intersect(x.ts, y.ts)) / (len(x.ts) + len(y.ts)) >= 0.55"


def _headings(rows: DataFrame) -> DataFrame:
    heads = F.transform(F.filter("blocks", lambda b: b["type"].isin("h2", "h3")), lambda b: b["text"])
    out = rows.select(F.floor(F.col("doc_id") / 8).alias("grp"), "doc_id", F.posexplode(heads).alias("n", "heading"))
    return out.withColumn("seq", F.col("doc_id") * 1000 + F.col("n") + 1).withColumn("url", F.col("doc_id").cast("string"))


@query(
    f"""{ARTICLES}, {_HEADS}, g0 AS (SELECT * FROM h x WHERE NOT mine AND length(heading) >= 8 AND NOT EXISTS (SELECT 1 FROM h y WHERE y.grp = x.grp AND y.mine AND {_ALIKE})),
g1 AS (SELECT x.grp, x.seq, coalesce((SELECT list(y.seq) FROM g0 y WHERE y.grp = x.grp AND y.seq < x.seq AND {_ALIKE}), []::BIGINT[]) AS sim FROM g0 x),
g2 AS (SELECT grp, list_reduce(list_concat([{{'seq': 0::BIGINT, 'sim': []::BIGINT[], 'lead': []::BIGINT[]}}], list({{'seq': seq, 'sim': sim, 'lead': []::BIGINT[]}} ORDER BY seq)), lambda x, y: {{'seq': y.seq, 'sim': y.sim, 'lead': CASE WHEN list_has_any(y.sim, x.lead) THEN x.lead ELSE list_append(x.lead, y.seq) END}}).lead AS lead FROM g1 GROUP BY grp),
g3 AS (SELECT grp, unnest(lead) AS seq FROM g2), g4 AS (SELECT x.seq, y.doc_id::VARCHAR AS url FROM g3 l JOIN g0 x ON x.seq = l.seq JOIN g0 y ON y.grp = x.grp AND (y.seq = x.seq OR (y.seq > x.seq AND y.seq NOT IN (SELECT seq FROM g3) AND {_ALIKE}))),
g5 AS (SELECT seq, count(DISTINCT url)::BIGINT AS n_sources FROM g4 GROUP BY seq), g6 AS (SELECT x.grp, x.seq, x.heading, n_sources, regexp_matches({S.strip("x.heading")}, {S.quoted(QUESTION)}) AS is_question FROM g5 JOIN g0 x USING (seq))
SELECT grp, seq, heading, n_sources, is_question, row_number() OVER (PARTITION BY grp ORDER BY n_sources DESC, is_question DESC, seq)::BIGINT AS k FROM g6 QUALIFY k <= 25"""
)
def g4_j3_topic_gaps(spark, d):
    heads = _headings(draft_articles(spark, d))
    mine, theirs = heads.filter("doc_id % 8 = 0"), heads.filter("doc_id % 8 != 0")
    found = compare.topic_gaps(mine.select("grp", "seq", "heading"), theirs.select("grp", "seq", "heading", "url"), "grp", f"{scratch_folder(spark)}/gaps")
    return compare.ranked_gaps(found, "grp").select("grp", "seq", "heading", "n_sources", "is_question", "k")


@query(
    f"""{ARTICLES}, {ENTITIES}, o AS (SELECT DISTINCT doc_id // 8 AS grp, lower(entity) AS e FROM en WHERE doc_id % 8 = 0), t AS (SELECT doc_id // 8 AS grp, doc_id, entity FROM en WHERE doc_id % 8 <> 0),
n AS (SELECT grp, entity, count(DISTINCT doc_id)::BIGINT AS n_sources FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.grp = t.grp AND o.e = lower(t.entity)) GROUP BY grp, entity)
SELECT grp, entity, n_sources, row_number() OVER (PARTITION BY grp ORDER BY n_sources DESC, entity)::BIGINT AS k FROM n QUALIFY k <= 15"""
)
def g5_entity_gaps(spark, d):
    found = findings.entities(draft_articles(spark, d), "doc_id").select(F.floor(F.col("doc_id") / 8).alias("grp"), "entity", F.col("doc_id").alias("url"))
    return compare.entity_gaps(found.filter("url % 8 = 0"), found.filter("url % 8 != 0"), "grp")


_PROFILE = f"""pr AS (SELECT doc_id // 8 AS grp, doc_id % 8 = 0 AS mine, {S.wc("text")} AS words, faqs AS faqs_n, len(images) AS images_n, len(list_filter(links, lambda x: starts_with(x.href, 'http'))) AS links_external, len(list_filter(blocks, lambda b: b.type = 'answer')) AS answer_blocks, {S.rx("text", findings.STATISTIC)} AS stats, {_ASKED} AS questions,
    (len(list_filter(blocks, lambda b: b.type = 'tldr')) > 0)::INT AS has_tldr, (len(types) > 0)::INT AS has_schema FROM a)"""
_MEASURES = ["words", "faqs_n", "images_n", "links_external", "answer_blocks", "stats", "questions"]


@query(
    f"""{ARTICLES}, {_PROFILE}, u AS ({" UNION ALL ".join(f"SELECT grp, mine, '{m}' AS measure, {m}::BIGINT AS v FROM pr" for m in _MEASURES)}),
s AS (SELECT grp, measure, max(v) FILTER (mine) AS own, max(v) FILTER (NOT mine) AS best, list_sort(list(v) FILTER (NOT mine)) AS al FROM u GROUP BY grp, measure)
SELECT grp, measure, own AS mine, best, al[len(al) // 2 + 1] AS median, own < best AS behind FROM s WHERE own IS NOT NULL AND best IS NOT NULL"""
)
def n9_h11_spreads(spark, d):
    rows = compare.profile(draft_articles(spark, d)).withColumn("grp", F.floor(F.col("doc_id") / 8))
    return compare.spreads(rows, "grp", F.col("doc_id") % 8 == 0, _MEASURES)


_ONLY = lambda k: f"SELECT grp, '{k}' AS win FROM s WHERE own_{k} > 0 AND other_{k} = 0"


@query(
    f"""{ARTICLES}, {_PROFILE}, s AS (SELECT grp, {", ".join(f"max({k}) FILTER (mine) AS own_{k}, max({k}) FILTER (NOT mine) AS other_{k}" for k in ("has_tldr", "answer_blocks", "has_schema", "words"))} FROM pr GROUP BY grp HAVING own_words IS NOT NULL AND other_words IS NOT NULL)
{" UNION ALL ".join(map(_ONLY, ("has_tldr", "answer_blocks", "has_schema")))} UNION ALL SELECT grp, 'words' FROM s WHERE own_words >= other_words"""
)
def n9_wins(spark, d):
    rows = compare.profile(draft_articles(spark, d)).withColumn("grp", F.floor(F.col("doc_id") / 8))
    return compare.wins(rows, "grp", F.col("doc_id") % 8 == 0)


# ---------------------------------------------------------------- keywords and ideas

_BARE = "lower(trim(w, ' ,।॥?.!:;\"''()'))"
_LEAD = f"(list_contains({S.names(L.LEADING_NOISE)}, {_BARE}) OR regexp_matches(w || ' ', {S.quoted(keywords.OPENERS)}))"
_TRAIL = f"list_contains({S.names(L.TRAILING_NOISE)}, {_BARE})"


def _front(xs: str) -> str:
    first = f"list_position(list_transform({xs}, lambda w: NOT {_LEAD}), true)"
    return f"CASE WHEN {first} > 0 THEN {xs}[{first}:] ELSE []::VARCHAR[] END"


def _back(xs: str) -> str:
    after = f"list_position(list_reverse(list_transform({xs}, lambda w: NOT {_TRAIL})), true)"
    return f"CASE WHEN {after} > 0 THEN {xs}[1:len({xs}) - {after} + 1] ELSE []::VARCHAR[] END"


_TOPICS = f"""tp0 AS (SELECT doc_id, 0 AS pos, title AS t, 'title' AS source FROM a UNION ALL SELECT doc_id, unnest(range(1, len(heads) + 1)), unnest(heads), 'heading' FROM a),
tp1 AS (SELECT *, {S.toks(f"trim(regexp_replace(t, '^{S.WS}*[0-9]+[.)]{S.WS}*', ''), ' ?:।॥.!')")} AS xs FROM tp0), tp2 AS (SELECT * REPLACE ({_front("xs")} AS xs) FROM tp1), tp3 AS (SELECT * REPLACE ({_back("xs")} AS xs) FROM tp2),
tp4 AS (SELECT * REPLACE (CASE WHEN len(xs) <= 5 THEN xs ELSE xs[len(xs) - 4:] END AS xs) FROM tp3), tp5 AS (SELECT * REPLACE ({_back("xs")} AS xs) FROM tp4), tp6 AS (SELECT * REPLACE ({_front("xs")} AS xs) FROM tp5),
tp7 AS (SELECT doc_id, pos, source, {S.clean("trim(array_to_string(xs, ' '), ' ,-–—')")} AS term FROM tp6), tp8 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY pos) AS n FROM tp7 WHERE length(term) > 2 AND length(term) < 60),
tp9 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS k, term, source FROM tp8 WHERE n = 1), tp AS (SELECT doc_id, k AS pos, term, source FROM tp9 WHERE k <= 10)"""


@query(f"{ARTICLES}, {_TOPICS} SELECT doc_id, pos, term, source FROM tp")
def c19_seeds(spark, d):
    return keywords.seeds(draft_articles(spark, d), "doc_id")


_STEMS = L.QUESTION_STEMS["hinglish"]
_GLUE = S.names([*L.TRAILING_NOISE, *L.STEM_GLUE])


@query(
    f"""{ARTICLES}, {_TOPICS}, st(i, stem) AS (VALUES {", ".join(f"({i + 1}, {S.quoted(s)})" for i, s in enumerate(_STEMS))}),
ow AS (SELECT *, list_transform({S.toks("term")}, lambda w: {_BARE}) AS own FROM tp), ex AS (SELECT doc_id, pos, 0 AS stem, term AS keyword, 'head' AS intent, source FROM ow
UNION ALL SELECT doc_id, pos, i, replace(stem, '{{}}', term), 'question', source FROM ow, st WHERE NOT list_has_any(list_filter(list_transform({S.toks("replace(stem, '{}', '')")}, lambda w: {_BARE}), lambda w: NOT list_contains({_GLUE}, w)), own)),
ey AS (SELECT * REPLACE ({S.clean("keyword")} AS keyword) FROM ex)
SELECT doc_id, pos, stem::BIGINT AS stem, keyword, intent, source FROM ey WHERE keyword <> '' AND length(keyword) <= 90 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(keyword) ORDER BY pos, stem) = 1"""
)
def c20_g13_keywords(spark, d):
    return keywords.expand(keywords.seeds(draft_articles(spark, d), "doc_id"), "doc_id", "hinglish")


_CANDIDATES = f"{_TOPICS}, ca AS (SELECT doc_id, pos, term AS query, CASE (doc_id + pos) % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'partial' ELSE 'covered' END AS status, CASE WHEN (doc_id + pos) % 3 > 0 THEN (doc_id + pos) % 4 END AS match FROM tp)"


def _candidates(rows: DataFrame) -> DataFrame:
    """The status and the post that a candidate meets follow from its number here."""
    n = F.col("doc_id") + F.col("pos")
    found = keywords.seeds(rows, "doc_id").withColumnRenamed("term", "query")
    return found.withColumns({"status": F.when(n % 3 == 0, "gap").when(n % 3 == 1, "partial").otherwise("covered"), "match": F.when(n % 3 > 0, n % 4)})


@query(
    f"""{ARTICLES}, {_CANDIDATES}, t1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'gap' THEN 0 ELSE 1 END, pos) AS o FROM ca WHERE status <> 'covered' QUALIFY o <= 8),
t2 AS (SELECT doc_id, o, upper(left({S.strip("query")}, 1)) || substr({S.strip("query")}, 2) AS title FROM t1), t3 AS (SELECT * FROM t2 WHERE length(title) > 15 AND length(title) < 70 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY o) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o)::BIGINT AS k, title FROM t3 QUALIFY k <= 5"""
)
def j7_title_options(spark, d):
    return keywords.title_options(_candidates(draft_articles(spark, d)), "doc_id")


@query(
    f"""{ARTICLES}, {_CANDIDATES}, l1 AS (SELECT *, CASE status WHEN 'covered' THEN 0 ELSE 1 END AS r FROM ca WHERE status <> 'gap' QUALIFY row_number() OVER (PARTITION BY doc_id, match ORDER BY CASE status WHEN 'covered' THEN 0 ELSE 1 END, pos) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, pos)::BIGINT AS k, match, query AS why FROM l1 QUALIFY k <= 6"""
)
def h12_n8_internal_links(spark, d):
    return keywords.internal_links(_candidates(draft_articles(spark, d)), "doc_id")


_ASK = [f"{p} ||| " for p in L.QUERY_PREFIX["en"]]


@query(
    f"""{S.pages()}, tq AS (SELECT DISTINCT title AS topic FROM p WHERE title <> ''), qs AS (SELECT topic, unnest(list_concat([topic], list_concat(list_transform({S.names(L.QUERY_PREFIX["en"])}, lambda x: x || ' ' || topic), list_transform({S.names([s for s in L.QUERY_SUFFIX["en"] if s])}, lambda x: topic || x)))) AS query FROM tq),
sg AS (SELECT query, query AS suggestion FROM qs UNION ALL SELECT query, query || ' really' FROM qs UNION ALL SELECT query, 'kidney pain today' FROM qs WHERE starts_with(query, 'how')),
h AS (SELECT topic, {S.strip("suggestion")} AS suggestion, count(*)::BIGINT AS hits FROM qs JOIN (SELECT DISTINCT query AS q, suggestion FROM sg) ON q = query WHERE length({S.strip("suggestion")}) > 4 GROUP BY ALL),
f AS (SELECT * FROM h WHERE lower(suggestion) = lower(topic) OR (lower(suggestion) NOT IN (SELECT lower(query) FROM qs WHERE qs.topic = h.topic) AND len(list_filter({S.token_set("suggestion", L.SITE_STOP)}, lambda w: NOT list_contains({S.token_set("topic", L.SITE_STOP)}, w))) > 0))
SELECT topic, suggestion, hits, row_number() OVER (PARTITION BY topic ORDER BY NOT contains(lower(suggestion), lower(topic)), hits DESC, length(suggestion), suggestion)::BIGINT AS k FROM f"""
)
def h14_a16_suggestions(spark, d):
    """What an autocomplete answers is made here: an echo, one word more, and the same answer to every "how"."""
    topics = html.page_rows(spread(table(spark, d, "pages")), only=["title"]).filter("title != ''").select(F.col("title").alias("topic")).distinct()
    asked = keywords.queries_of(topics, "topic")
    q = F.col("query")
    given = asked.select("query").distinct().select("query", F.explode(F.array_compact(F.array(q, F.concat(q, F.lit(" really")), F.when(F.startswith(q, F.lit("how")), "kidney pain today")))).alias("suggestion"))
    return keywords.suggested(asked, given, "topic")


# ---------------------------------------------------------------- edited pairs: each document with an addition, and changed

ADDED = "Take 500 mg twice daily, up to 1,000 mg. It may help; consult a doctor. Write to info@example.com or WhatsApp."
_EDITS = [("500", "50"), ("It may help; consult a doctor. ", ""), ("may help", "is guaranteed to help"), ("WhatsApp", "mail"), ("twice", "2 times")]


def edited_pairs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, before, after: the text with a sentence in front, and the same with an edit that the id chooses, or half of it."""
    i, before = F.col("doc_id"), F.concat(F.lit(ADDED + " "), F.coalesce("text", F.lit("")))
    after = F.when(i % 7 == 6, F.substring(before, F.lit(1), F.floor(F.length(before) / 2).cast("int")))
    for n, (a, b) in enumerate(_EDITS):
        after = after.when(i % 7 == n, F.replace(before, F.lit(a), F.lit(b)))
    return spread(documents(spark, d).select("doc_id", "text")).select("doc_id", before.alias("before"), after.otherwise(before).alias("after"))


PAIRS = f"""WITH ep0 AS (SELECT doc_id, {S.quoted(ADDED + " ")} || coalesce(text, '') AS before FROM documents),
ep AS (SELECT *, CASE doc_id % 7 WHEN 6 THEN left(before, length(before) // 2) {" ".join(f"WHEN {n} THEN replace(before, {S.quoted(a)}, {S.quoted(b)})" for n, (a, b) in enumerate(_EDITS))} ELSE before END AS after FROM ep0)"""

# word and digit runs are marked by two characters, so that RE2, which has no look-around, can name their ends
_MARK, _END = "chr(5)", "chr(6)"


def _marked(t: str, run: str) -> str:
    return f"regexp_replace({t}, '({run}+)', {_MARK} || '\\1' || {_END}, 'g')"


def _unmarked(t: str) -> str:
    return f"translate({t}, chr(5) || chr(6), '')"


_RUN = r"[\p{L}\p{N}_]"
_SP = r"[ \t\n\x0B\f\r]"


def _prepared(t: str) -> str:
    """ASCII digits, enumerators out."""
    digits = f"translate(coalesce({t}, ''), {S.quoted(L.INDIC_DIGITS)}, {S.quoted(L.ASCII_DIGITS)})"
    return _unmarked(f"regexp_replace({_marked(digits, '[0-9]')}, chr(5) || '[0-9]{{1,2}}' || chr(6) || '[.)](' || '{_SP}' || '|$)', '  \\1', 'g')")


_KIND_SQL = [
    ("url", "plain", r"https?://[^ \t\n\x0B\f\r<>\"'')]+"),
    ("email", "plain", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"),
    ("phone", "marked", rf"(?:\+\x0591(?:\x06(?:{_SP}|-)\x05)?)?[6-9][0-9]{{9}}\x06"),
    ("dosage", "marked", rf"(?i)[0-9]+(?:\x06[.,]\x05[0-9]+)?(?:\x06{_SP}+\x05)?(?:mg|ml|mcg|gm|kg|g|IU)\x06"),
    ("price_inr", "plain", rf"(?:₹|Rs\.?|INR){_SP}*[0-9][0-9,]*(?:\.[0-9]+)?"),
    ("percent", "plain", rf"[0-9]+(?:\.[0-9]+)?{_SP}*%"),
    ("number", "marked", r"\x05[0-9]+(?:\x06[.,]\x05[0-9]+)*\x06"),
]


def _spans_sql(source: str, t: str, key: str = "doc_id") -> str:
    """CTEs up to sp_<t> (key, kind, value): the matches of each kind in the whole text, with their places from the lengths of
    what stands between them; kind by kind, those that overlap a span already taken go."""
    steps = [f"{t}_0 AS (SELECT {key}, {_prepared(t)} AS r FROM {source})"]
    for n, (kind, how, pattern) in enumerate(_KIND_SQL):
        seen = f"{_marked('r', _RUN)}" if how == "marked" else "r"
        plain = f"lambda v: {_unmarked('v')}"
        steps.append(f"{t}_m{n} AS (SELECT {key}, list_transform(regexp_extract_all({seen}, '{pattern}'), {plain}) AS f, list_transform(string_split(regexp_replace({seen}, '{pattern}', chr(3), 'g'), chr(3)), {plain}) AS p FROM {t}_0)")
        steps.append(f"{t}_u{n} AS (SELECT {key}, f[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM {t}_m{n}))")
        taken = f" WHERE NOT EXISTS (SELECT 1 FROM {t}_k{n - 1} c WHERE c.{key} = u.{key} AND c.a < u.a + length(u.v) AND u.a < c.b) UNION ALL SELECT * FROM {t}_k{n - 1}" if n else ""
        steps.append(f"{t}_k{n} AS (SELECT {key}, '{kind}' AS kind, trim(v, ' ') AS value, a, a + length(v) AS b FROM {t}_u{n} u{taken})")
    return ", ".join(steps) + f", sp_{t} AS (SELECT {key}, kind, value FROM {t}_k{len(_KIND_SQL) - 1})"


_CANON = "CASE WHEN kind = 'price_inr' THEN regexp_replace(regexp_replace(lower(value), '[ \\t\\n\\r\\f\\x0B,]', '', 'g'), '^(rs\\.?|inr|₹)', '') ELSE regexp_replace(lower(value), '[ \\t\\n\\r\\f\\x0B,]', '', 'g') END"


@query(f"{PAIRS}, {_spans_sql('ep', 'before')} SELECT doc_id, kind, value FROM sp_before")
def f1_protected_spans(spark, d):
    return integrity.protected_spans(edited_pairs(spark, d), "before", ["doc_id"])


_DIFF = f"""{_spans_sql("ep", "before")}, {_spans_sql("ep", "after")}, df0 AS (SELECT doc_id, kind, {_CANON} AS value, 1 AS n FROM sp_before UNION ALL SELECT doc_id, kind, {_CANON}, -1 FROM sp_after),
df AS (SELECT doc_id, kind, value, sum(n) AS n FROM df0 GROUP BY ALL HAVING sum(n) <> 0)"""


@query(f"{PAIRS}, {_DIFF} SELECT doc_id, kind, value, CASE WHEN n > 0 THEN 'dropped' ELSE 'invented' END AS issue, abs(n)::BIGINT AS n FROM df")
def f3_protected_diff(spark, d):
    return integrity.protected_diff(edited_pairs(spark, d), "before", "after", ["doc_id"])


def _numbers(t: str) -> str:
    one = f"regexp_replace({{}}, '([0-9])' || chr(6) || ',' || chr(5) || '([0-9]{{{{3}}}})' || chr(6), '\\1\\2' || chr(6), 'g')"
    digits = _marked(f"translate(coalesce({t}, ''), {S.quoted(L.INDIC_DIGITS)}, {S.quoted(L.ASCII_DIGITS)})", _RUN)
    joined = _unmarked(one.format(one.format(digits)))
    cleaned = _unmarked(f"regexp_replace({_marked(joined, '[0-9]')}, chr(5) || '[0-9]{{1,2}}' || chr(6) || '[.)](' || '{_SP}' || '|$)', ' \\1', 'g')")
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({cleaned}, '[0-9]+(?:\\.[0-9]+)?'), lambda v: CASE WHEN ltrim(v, '0') = '' THEN '0' ELSE ltrim(v, '0') END)))"


_GUARD = f"""gd AS (SELECT *, {_numbers("before")} AS ns, {_numbers("after")} AS nt, lower(before) AS s, lower(after) AS t FROM ep),
gf AS (SELECT *, list_filter(nt, lambda x: NOT list_contains(ns, x)) AS invented, list_filter(ns, lambda x: NOT list_contains(nt, x)) AS dropped, list_filter({S.names(integrity.NEVER)}, lambda c: contains(s, lower(c)) AND NOT contains(t, lower(c))) AS missing,
    list_filter({S.names(integrity.CLAIMS)}, lambda c: contains(t, lower(c)) AND NOT contains(s, lower(c))) AS claims, len(list_filter({S.names(integrity.HEDGES)}, lambda c: contains(s, lower(c)))) > 0 AND len(list_filter({S.names(integrity.HEDGES)}, lambda c: contains(t, lower(c)))) = 0 AS lost FROM gd)"""


@query(f"{PAIRS}, {_GUARD} SELECT doc_id, array_to_string(invented, ',') AS invented, array_to_string(dropped, ',') AS dropped FROM gf")
def f2_number_diff(spark, d):
    rows = integrity.number_diff(edited_pairs(spark, d), "before", "after")
    return rows.select("doc_id", F.array_join("invented", ",").alias("invented"), F.array_join("dropped", ",").alias("dropped"))


@query(f"{PAIRS}, {_GUARD} SELECT CASE WHEN len(invented) > 0 THEN 'blocking' WHEN len(dropped) > 0 THEN 'review' ELSE 'safe' END AS verdict, count(*)::BIGINT AS n FROM gf GROUP BY 1")
def f6_fix_verdicts(spark, d):
    return integrity.fix_verdict(edited_pairs(spark, d), "before", "after").groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"{PAIRS}, {_GUARD} SELECT doc_id, array_to_string(missing, ',') AS missing_terms, array_to_string(claims, ',') AS new_claims, lost AS hedge_lost FROM gf")
def e2_guard(spark, d):
    rows = integrity.guard(edited_pairs(spark, d), "before", "after")
    return rows.select("doc_id", F.array_join("missing_terms", ",").alias("missing_terms"), F.array_join("new_claims", ",").alias("new_claims"), "hedge_lost")


FIDELITY = f"""{_GUARD}, {_DIFF}, dn AS (SELECT doc_id, sum(abs(n)) AS spans FROM df GROUP BY doc_id),
fi0 AS (SELECT gf.*, coalesce(spans, 0) AS spans, {S.token_set("before", L.OVERLAP_STOP, 3, "[a-z]+")} AS ca, {S.token_set("after", L.OVERLAP_STOP, 3, "[a-z]+")} AS cb, {S.wc("before")} AS ws, {S.wc("after")} AS wt FROM gf LEFT JOIN dn USING (doc_id)),
fi1 AS (SELECT *, CASE WHEN len(ca) = 0 THEN 1.0 ELSE len(list_intersect(ca, cb)) / len(ca) END::DOUBLE AS overlap, CASE WHEN ws = 0 THEN 1.0 ELSE wt / ws END::DOUBLE AS ratio FROM fi0),
fi2 AS (SELECT *, len(invented) + len(dropped) + (len(missing) > 0)::INT + (len(claims) > 0)::INT + lost::INT + spans + (ratio < 0.7)::INT AS errors FROM fi1),
fi AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.55::DOUBLE * {S.norm("overlap", 0.80, 0.35)} + 0.25::DOUBLE * {S.norm("least(ratio, 1.0)", 1.0, 0.60)} + 20.0::DOUBLE - 12.0::DOUBLE * errors)), 1) AS fidelity FROM fi2)"""


@query(f"{PAIRS}, {FIDELITY} SELECT doc_id, round(overlap, 3) AS overlap, round(ratio, 3) AS length_ratio, errors::BIGINT AS errors, fidelity FROM fi")
def e1_fidelity(spark, d):
    rows = integrity.fidelity(edited_pairs(spark, d), "before", "after", L.OVERLAP_STOP, "after")
    return rows.select("doc_id", "overlap", "length_ratio", scoring.errors().cast("long").alias("errors"), "fidelity")


@query(
    f"""{PAIRS}, {_spans_sql("ep", "before")}, sn AS (SELECT doc_id, {S.sents("before", ".!?।॥")} AS s FROM ep)
SELECT DISTINCT doc_id, kind, value, left(coalesce(list_filter(s, lambda x: contains(x, value))[1], ''), 180) AS context FROM sp_before JOIN sn USING (doc_id)"""
)
def e14_claim_audit(spark, d):
    return integrity.claim_audit(edited_pairs(spark, d), "doc_id", "before")


@query(
    f"""{ARTICLES}, {AEO}, ep0 AS (SELECT doc_id, {S.quoted(ADDED + " ")} || coalesce(text, '') AS before FROM documents),
ep AS (SELECT *, CASE doc_id % 7 WHEN 6 THEN left(before, length(before) // 2) {" ".join(f"WHEN {n} THEN replace(before, {S.quoted(x)}, {S.quoted(y)})" for n, (x, y) in enumerate(_EDITS))} ELSE before END AS after FROM ep0), {_GUARD},
bu AS (SELECT * FROM ({S.burstiness()})), de AS (SELECT * FROM ({S.detect()} SELECT doc_id, round(100.0::DOUBLE - total, 1) AS ai FROM d)),
eg AS (SELECT ae.doc_id, 0.40::DOUBLE * aeo + 0.35::DOUBLE * burstiness + 0.25::DOUBLE * coalesce(quality * 100.0::DOUBLE, 75.0::DOUBLE) AS total, ai, len(invented) + len(dropped) + (len(missing) > 0)::INT + (len(claims) > 0)::INT + lost::INT AS blocking
    FROM ae JOIN gf USING (doc_id) JOIN bu USING (doc_id) JOIN de USING (doc_id) LEFT JOIN labels USING (doc_id))
SELECT doc_id, round(round(total, 6), 1) AS draft_score, blocking::BIGINT AS blocking, total >= 70 AND ai <= 20 AND blocking = 0 AS passed FROM eg"""
)
def e12_e7_english_gate(spark, d):
    """Structure of the draft, rhythm and likeness of the document, the label as review, and the guard on its edited pair."""
    docs = spread(documents(spark, d))
    reviews = table(spark, d, "labels").select("doc_id", (F.col("quality") * 100.0).alias("score"))
    rows = articles.structure(draft_articles(spark, d)).select("doc_id", "aeo").join(scoring.burstiness(docs).select("doc_id", "burstiness"), "doc_id")
    rows = rows.join(scoring.detect(docs).select("doc_id", "ai_likeness"), "doc_id").join(integrity.guard_flags(edited_pairs(spark, d), "before", "after").select("doc_id", "flags"), "doc_id")
    return scoring.english_gate(scoring.reviewed(rows, reviews, "doc_id")).select("doc_id", "draft_score", "blocking", "passed")
