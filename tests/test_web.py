"""Fetching, crawls and loading with a fetcher that answers from a dict."""

import pytest

from scriptorium.sources import html, web

PAGES = {
    "https://s.org/robots.txt": (200, b"User-agent: *\nDisallow: /private\nSitemap: https://s.org/map.xml", "text/plain"),
    "https://s.org/map.xml": (200, b"<sitemapindex><loc>https://s.org/a.xml</loc><loc>https://s.org/lost.xml</loc></sitemapindex>", "text/xml"),
    "https://s.org/a.xml": (200, b"<urlset><loc>https://s.org/1</loc><loc>https://s.org/2</loc><loc>https://s.org/private/3</loc><loc>https://s.org/x.pdf</loc><loc>https://s.org/1</loc></urlset>", "text/xml"),
    "https://s.org/1": (200, "<html><head><title>Eins</title></head><body><p>ä b</p></body></html>".encode(), "text/html"),
    "https://s.org/2": (404, b"", "text/html"),
    "https://s.org/pdf": (200, b"%PDF", "application/pdf"),
}


def fetcher():
    """A function within a function goes to the workers by value."""
    pages = dict(PAGES)

    def ask(url):
        if url not in pages:
            raise OSError("no such host")
        status, body, kind = pages[url]
        return web.Response(status, url, body, kind, "iso-8859-1")

    return ask


fetch = fetcher()


def test_decoding_and_retries():
    assert web.decoded(web.Response(200, "", "ä".encode(), charset="ISO-8859-1")) == "ä"
    assert web.decoded(web.Response(200, "", b"\xe4")) == "ä"
    asked = []

    def poor(url):
        asked.append(url)
        if len(asked) < 3:
            raise OSError
        return fetch("https://s.org/1")

    assert web.retried(poor, wait=0)("x").status == 200 and len(asked) == 3
    with pytest.raises(OSError, match="no such"):
        web.retried(fetch, 2, 0)("http://nowhere")


def test_fetched_rows_hold_errors(spark):
    urls = spark.createDataFrame([("https://s.org/1",), ("https://s.org/2",), ("https://s.org/pdf",), ("http://nowhere",)], "url string")
    got = {r.url: r for r in web.fetched(urls, fetch, pause=0).collect()}
    assert "ä b" in got["https://s.org/1"].html
    assert [(got[u].status, got[u].html, got[u].error) for u in ("https://s.org/2", "https://s.org/pdf", "http://nowhere")] == [(404, None, None), (200, None, "not html (application/pdf)"), (0, None, "OSError: no such host")]


def test_crawl_goes_on(spark, tmp_path):
    assert web.discover("s.org", fetch) == "https://s.org/map.xml" and web.discover("none.org", fetch) is None
    urls = web.site_urls(spark, "https://s.org/map.xml", fetch)
    assert sorted(r.url for r in urls.collect()) == ["https://s.org/1", "https://s.org/2", "https://s.org/private/3"]
    assert web.site_urls(spark, "https://s.org/map.xml", fetch, contains="/2").count() == 1
    path, robots = str(tmp_path / "store"), PAGES["https://s.org/robots.txt"][1].decode()
    first = web.crawl(spark, urls.filter("url like '%1'"), path, fetch, robots, pause=0)
    assert first.count() == 1
    seq = first.first().seq
    rows = {r.url: r for r in web.crawl(spark, urls, path, fetch, robots, pause=0).collect()}
    assert set(rows) == {"https://s.org/1", "https://s.org/2"} and rows["https://s.org/1"].seq == seq < rows["https://s.org/2"].seq
    again = web.crawl(spark, urls, path, fetch, robots, pause=0, refresh=True)
    assert {r.url: r.seq > seq for r in again.collect()} == {"https://s.org/1": True, "https://s.org/2": True}
    page = web.pages(again).filter("title != ''").first()
    assert (page.url, page.title, page.words) == ("https://s.org/1", "Eins", 2)


def test_load(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T")
    assert [(r.text, r.kind, r.error) for r in web.load(spark, fetch, file=str(tmp_path)).collect()] == [("# T", "markdown", None)]
    got = {r.path: r.error for r in web.load(spark, fetch, urls=["https://s.org/1", "https://s.org/2"], pause=0).collect()}
    assert got == {"https://s.org/1": None, "https://s.org/2": "status 404"}
    assert web.load(spark, fetch, sitemap="https://s.org/map.xml", pause=0).count() == 3
    with pytest.raises(ValueError, match="exactly|one of"):
        web.load(spark, fetch)


PAGE = """<html lang='de'><head><title>T</title><meta content='A &amp;amp; &#8364;' name=Description><meta property="og:description" content="no"><meta name="author" content="Ann">
<link href=/c rel='canonical'><script type="application/ld+json">{"@graph": [{"@type": ["Article", "FAQPage"], "datePublished": "2026-01-02"}, {"@type": "Thing"}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href=/n>n</a></nav><article><h1>Head</h1><h2>Why so?</h2><p>Because &eacute;&nbsp;x</p><p>More</p><img data-src='/l.png' alt=' x '><img src=/m.png><a href='../up/./p?q=1#f'>go</a><a href=b></a></article></body></html>"""


def test_attributes_and_articles(spark):
    pages = spark.createDataFrame([(1, "https://h.de/a/b/c", PAGE), (2, "https://h.de/", "")], "page_id int, url string, html string")
    r = html.page_rows(pages).filter("page_id = 1").first()
    assert (r.description, r.author, r.canonical, r.lang, r.published, r.schema_types) == ("A &amp; €", "Ann", "/c", "de", "2026-01-02", ["Article", "FAQPage", "Thing"])
    assert r.links == ["/n", "../up/./p?q=1#f", "b"] and r.body_links == r.links[1:] and (r.images, r.images_no_alt) == (2, 1)
    a = html.article_rows(pages, "page_id").filter("page_id = 1").first()
    assert (a.title, a.slug, [(b.type, b.text) for b in a.blocks]) == ("Head", "c", [("h2", "Why so?"), ("p", "Because é x"), ("p", "More")])
    assert [(i.src, i.alt) for i in a.images] == [("/l.png", "x"), ("/m.png", "")] and [(x.href, x.text) for x in a.links] == [("../up/./p?q=1#f", "go")]
    assert [(f.q, f.a) for f in a.faqs] == [("Why so?", "Because é x More")]
    empty = html.article_rows(pages, "page_id").filter("page_id = 2").first()
    assert (empty.title, empty.blocks, empty.images, empty.links, empty.faqs, empty.schema_types) == ("", [], [], [], [], [])
    from scriptorium.operators import corpus

    assert {x.target for x in corpus.link_rows(html.page_rows(pages)).collect()} == {"https://h.de/n", "https://h.de/a/up/p?q=1", "https://h.de/a/b/b"}
