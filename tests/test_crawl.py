from scriptorium.operators import crawl

COLUMNS = "url string, final_url string, redirects int, status int, error string, title string, description string, h1 array<string>, words long, content_hash string, canonical string, robots string, images_no_alt long, schema_types array<string>"
TITLE, META = "A title that is long enough for it", "d" * 100


def page(url, **other):
    row = {"url": url, "final_url": None, "redirects": 0, "status": 200, "error": None, "title": TITLE + url, "description": META + url, "h1": ["x"], "words": 500, "content_hash": url, "canonical": "", "robots": "", "images_no_alt": 0, "schema_types": ["Article"]}
    return tuple((row | other).values())


def test_issues_of_a_small_site(spark):
    a, b, c = (f"https://s.org/{x}" for x in "abc")
    pages = spark.createDataFrame(
        [
            page(a + "/", title="", canonical=a),
            page(b, description=META + "c", robots="noindex", content_hash="same"),
            page("https://s.org/old", final_url=c, redirects=1, description=(META + "C ").replace("dC", "dc"), content_hash="same", words=100),
            page("https://s.org/gone", status=404, title="", h1=[]),
            page("https://s.org/late", error="timeout"),
            (None,) * 14,
        ],
        COLUMNS,
    )
    rows = [(b, a), (a + "/", c), (b, c), ("https://s.org/old", c), (b, "https://s.org/gone"), (b, "https://s.org/new"), (a + "/", "https://s.org/new")]
    links = spark.createDataFrame([(u, t, True) for u, t in rows] + [(b, "https://else.org/x", False)], "url string, target string, internal boolean")
    checked = spark.createDataFrame([("https://s.org/gone", 404), ("https://else.org/x", 500)], "target string, status int")
    found = crawl.issues(pages, links, checked).collect()
    assert {(r.kind, r.url, r.value) for r in found} == {
        ("missing_title", a + "/", ""),
        ("noindex", b, "noindex"),
        ("duplicate_meta", b, (META + "c")[:90]),
        ("duplicate_meta", "https://s.org/old", (META + "c")[:90]),
        ("redirect", "https://s.org/old", c),
        ("thin", "https://s.org/old", "100"),
        ("error_status", "https://s.org/gone", "404"),
        ("error_status", "https://s.org/late", "timeout"),
        ("broken_internal", b, "https://s.org/gone"),
        ("few_inbound", a + "/", "1"),
        ("orphan", b, "0"),
    }
    assert len(found) == 11
    partial = crawl.issues(pages, links, checked, complete=False)
    counts = {(r.kind, r.severity): r.n for r in crawl.summary(partial, pages, links, checked, complete=False).collect()}
    assert counts[("links_unverified", "note")] == 1 and counts[("link_graph_skipped", "note")] == 0 and not {"orphan", "few_inbound"} & {k for k, _ in counts}
    assert crawl.totals(partial, pages, complete=False).first().asDict() == {"pages_crawled": 6, "pages_ok": 3, "fail": 5, "warn": 4, "words_median": 500, "with_schema": 3, "orphans": None}


def test_empty_crawl(spark):
    pages = spark.createDataFrame([], COLUMNS)
    links = spark.createDataFrame([], "url string, target string, internal boolean")
    checked = spark.createDataFrame([], "target string, status int")
    found = crawl.issues(pages, links, checked)
    assert found.count() == 0 and crawl.summary(found, pages, links, checked).count() == 0
    assert crawl.totals(found, pages).first().asDict() == {"pages_crawled": 0, "pages_ok": 0, "fail": 0, "warn": 0, "words_median": 0, "with_schema": 0, "orphans": 0}
