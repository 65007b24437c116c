from pyspark.sql import functions as F

from scriptorium.operators import articles, rewriting, similarity

SCHEMA = "id int, title string, meta_description string, slug string, blocks array<struct<type:string,text:string>>, faqs array<struct<q:string,a:string>>, schema_types array<string>, keywords array<string>, links array<struct<href:string,text:string>>"


def article(spark, **of):
    row = {"id": 1, "title": "Kidney Stone Diet Guide", "meta_description": "d" * 80, "slug": "x", "blocks": [("h2", "What is it?"), ("answer", "w " * 50), ("p", "kidney stone diet and kidney stone diet help"), ("tldr", "t")], "faqs": [("q", "a")] * 6, "schema_types": ["Article", "FAQPage", "BreadcrumbList"], "keywords": ["kidney", "absent"], "links": [("/a", "here"), ("http://x.org/b", "good text"), ("https://www.h.com/c", "Read more")]} | of
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def test_structure(spark):
    r = articles.structure(article(spark)).first()
    assert r.aeo == 100.0 and r.flags == []
    r = articles.structure(article(spark, blocks=[("p", "x")], faqs=[], schema_types=[], title="", meta_description=None)).first()
    assert r.aeo == 0.1 * 40 + 0.05 * 40 and len(r.flags) == 6


def test_keyword(spark):
    assert articles.keyword(article(spark)).first().keyword == "kidney stone diet"
    assert articles.keyword(article(spark, title="The Of")).first().keyword == ""
    assert articles.keyword(article(spark, title="Help Kidney")).first().keyword == "kidney"
    got = {r.term: r.advice for r in articles.keyword_brief(article(spark)).collect()}
    assert got == {"kidney": "stuffed", "absent": "missing"}
    r = articles.anchors(article(spark), "h.com").first()
    assert (r.internal, r.external, r.generic) == (2, 1, 2)


def test_leaders(spark, tmp_path):
    pairs = [(1, 2), (2, 3), (3, 4), (5, 6), (5, 7), (6, 8)]
    got = similarity.leaders(spark.createDataFrame(pairs, "a long, b long"), str(tmp_path)).collect()
    assert {(r.leader, r.member) for r in got} == {(1, 2), (3, 4), (5, 6), (5, 7)}


def test_link_suggestions(spark):
    pages = spark.createDataFrame([("http://x/1", "kidney stone diet"), ("http://x/2", "kidney stone pain"), ("http://x/3", "kidney stone diet plan"), ("http://x/4", "other words")], "url string, title string")
    links = spark.createDataFrame([("http://x/3", "http://x/1")], "url string, target string")
    degrees = spark.createDataFrame([("http://x/1", 1)], "target string, n long")
    got = {(r.target[-1], r.source[-1], r.score) for r in articles.link_suggestions(pages, links, degrees).collect()}
    assert got == {("1", "2", 0.67), ("2", "1", 0.67), ("2", "3", 0.67), ("3", "1", 0.75), ("3", "2", 0.5)}


def test_spread(spark):
    mine, others = spark.createDataFrame([(5, 1)], "words int, faqs int"), spark.createDataFrame([(9, 0), (4, 1), (6, 1), (1, 1)], "words int, faqs int")
    got = {r.measure: (r.mine, r.best, r.median, r.behind) for r in articles.spread(mine, others, ["words", "faqs"]).collect()}
    assert got == {"words": (5, 9, 6, True), "faqs": (1, 1, 1, False)}


SOURCE = "500 mg dose under supervision. Consult a doctor before starting."
GOOD = "Take 500 mg under supervision and consult a doctor."
BAD = "Take 50 mg under supervision and consult a doctor."
NO_HEDGE = "Take 500 mg."


def provider(answer):
    return lambda texts: (answer for _ in texts)


def test_rewrite_loop(spark):
    df = spark.createDataFrame([(1, SOURCE, GOOD), (2, SOURCE, BAD)], "id int, s string, t string")
    got = {r.id: (r.passes, r.status) for r in rewriting.repair(df, provider(GOOD), "s", "t").collect()}
    assert got == {1: (0, "scored"), 2: (1, "scored")}
    bad = df.filter("id = 2")
    r = rewriting.repair(bad, provider(BAD), "s", "t").first()
    assert r.passes <= 2 and r.status == "needs_human_review"
    r = rewriting.repair(bad, provider(NO_HEDGE), "s", "t").first()
    assert (r.passes, r.status, r.t) == (1, "needs_human_review", BAD)
    assert rewriting.repair(bad, provider(None), "s", "t").first().status == "needs_human_review"


def test_cache_asks_for_what_is_missing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, t string")
    cache = df.filter("id = 1").select(F.sha2("t", 256).alias("key"), F.lit("A").alias("value"))
    got = {r.id: r.x for r in rewriting.cached(df, cache, lambda texts: (t + "!" for t in texts), "t", "x").collect()}
    assert got == {1: "A", 2: "b!", 3: "b!"}
