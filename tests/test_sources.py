from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import findings
from scriptorium.sources import markdown, site_files

POST = """# Early Signs

Intro para with 500 mg.

## What are the signs?
First answer here.

## Care
- one
- two
1. three
> said

# Another Top
### Is it deep?
Yes it is.
"""


def test_markdown(spark):
    df = spark.createDataFrame([(1, POST), (2, None)], "id int, text string")
    rows = markdown.blocks(df, "id").orderBy("pos").collect()
    assert [(r.type, r.text) for r in rows] == [
        ("h1", "Early Signs"), ("p", "Intro para with 500 mg."), ("h2", "What are the signs?"), ("p", "First answer here."), ("h2", "Care"), ("li", "one"), ("li", "two"), ("li", "three"), ("quote", "said"),
        ("h2", "Another Top"), ("h3", "Is it deep?"), ("p", "Yes it is."),
    ]
    blocks = markdown.blocks(df, "id")
    assert {(r.q, r.a) for r in markdown.faqs(blocks, "id").collect()} == {("What are the signs?", "First answer here."), ("Is it deep?", "Yes it is.")}
    assert markdown.title_of(blocks, "id").first().title == "Early Signs"
    again = markdown.to_markdown(blocks, "id").withColumnRenamed("markdown", "text")
    assert [r.text for r in markdown.blocks(again, "id").orderBy("pos").collect()] == [r.text for r in rows]


def test_faq_length_guard(spark):
    rows = [(1, 0, "h2", "Why?"), (1, 1, "p", "a" * 701), (1, 2, "p", "left out")]
    assert len(markdown.faqs(spark.createDataFrame(rows, "id int, pos int, type string, text string"), "id").first().a) == 701


def test_chunks(spark):
    word = lambda n: " ".join(["w"] * n)
    rows = [(1, 0, "p", word(200)), (1, 1, "p", word(150)), (1, 2, "p", word(10)), (1, 3, "h2", "This one"), (1, 4, "p", "This " + word(600)), (1, 5, "h3", "Empty"), (1, 6, "h3", "Last"), (1, 7, "p", "x")]
    got = findings.chunks(spark.createDataFrame(rows, "id int, pos int, type string, text string"), "id").orderBy("chunk").collect()
    assert [(r.heading, r.words) for r in got] == [("", 350), ("", 10), ("This one", 601), ("Last", 1)]
    r = findings.readiness(spark.createDataFrame(got), "id").first()
    assert (r.n, r.orphans, r.oversized, r.readiness) == (4, 1, 1, 82.5)


def test_robots(spark):
    txt = "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open # c\nSitemap: http://x/s.xml\n"
    df = spark.createDataFrame([(1, txt), (2, "User-agent: *\nDisallow: /"), (3, None)], "id int, robots string")
    got = {(r.id, r.agent): (r.state, r.explicit) for r in site_files.crawler_access(df, "id").collect()}
    assert got[1, "GPTBot"] == ("allowed", True) and got[1, "CCBot"] == ("blocked", True) and got[1, "Bytespider"] == ("allowed", False)
    assert got[2, "GPTBot"] == ("blocked_by_wildcard", False) and got[3, "GPTBot"] == ("allowed", False)
    assert df.filter("id = 1").select(site_files.sitemap_of_robots(F.col("robots")).alias("s")).first().s == "http://x/s.xml"
    urls = spark.createDataFrame([("/private/x",), ("/private/open/y",), ("/z",), ("",)], "path string")
    rules = site_files.robots_rules(df.filter("id = 1"), "id")
    assert {r.path for r in site_files.robots_allowed(urls, rules).collect()} == {"/private/open/y", "/z", ""}


def test_sitemaps_and_llms(spark):
    files = spark.createDataFrame(
        [
            ("http://x/i.xml", "<sitemapindex><sitemap><loc> http://x/a.xml </loc></sitemap><sitemap><loc>http://x/i.xml</loc></sitemap></sitemapindex>"),
            ("http://x/a.xml", '<s:urlset xmlns:s="n"><s:url><s:loc>http://x/blog/1?a=1&amp;b</s:loc></s:url><s:url><s:loc>http://x/p.jpg</s:loc></s:url></s:urlset>'),
        ],
        "url string, xml string",
    )
    assert [r.url for r in site_files.walk_sitemaps(spark, files, ["http://x/i.xml"]).collect()] == ["http://x/blog/1?a=1&b"]
    pages = spark.createDataFrame([("http://x/blog/a", "A", 5, ""), ("http://x/blog/b", "B", 9, "about"), ("http://x/c", " ", 1, ""), ("http://x/", "Home", 2, "")], "url string, title string, words int, description string")
    got = {r.section: r.text for r in site_files.llms_txt(pages).collect()}
    assert got == {"Blog": "- [B](http://x/blog/b): about\n- [A](http://x/blog/a)", "C": "- [http://x/c](http://x/c)", "Pages": "- [Home](http://x/)"}
    whole = site_files.llms_file(site_files.llms_txt(pages), "Brand", "What it is").first().text
    assert whole.startswith("# Brand\n\n> What it is\n\n## Blog\n\n- [B]") and whole.endswith("\n")
    audited = site_files.audit_llms(spark.createDataFrame([(1, whole), (2, None)], "id int, llms string"), "id")
    assert [(r.present, r.has_h1, r.has_summary, r.n_sections, r.n_links) for r in audited.orderBy("id").collect()] == [(True, True, True, 3, 4), (False, False, False, 0, 0)]
    urls = spark.createDataFrame([(1, "http://x/c/"), (1, "http://x/new")], "id int, url string")
    assert site_files.coverage(audited, urls, "id").first().coverage == 0.5


def test_findings(spark):
    text = "According to a study, 50 percent of cases improved in 2024. Kidney Care is a method. Kidney Care helps.\nStep 1 do this\n- a\n- b\n- c"
    r = findings.freshness(findings.citation(spark.createDataFrame([(1, text)], "id int, text string")), 2027).first()
    assert (r.citation, r.newest, r.stale) == (60, 2024, True)
    assert not findings.citation(spark.createDataFrame([("50% of",)], "text string")).first().has_stats
    e = findings.entities(spark.createDataFrame([(1, text)], "id int, text string"), "id").collect()
    assert [(r.entity, r.n) for r in e] == [("Kidney Care", 2)]
    assert T.with_flesch(spark.createDataFrame([("banana",)], "text string")).first().flesch == 0.0
