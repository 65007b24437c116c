import random

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import pagediff

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><article class="post"><h1>Head &amp; more</h1><p><b>First <i>para</i>
graph<br>here<p>Second&nbsp;&lt;p&gt; &eacute;</p><aside>Side</aside><form><input name="q">Send</form><ul><li>one<li>two</ul><div class="share-buttons">Share</div><section class="comments"><p>Great!</p></section></article>
<section id="comments"><article class="comment">No!</article></section><footer>&copy; x</footer></body></html>"""


def test_marked_article():
    own, marked = pagediff.blocks(ARTICLE)
    assert marked
    assert own == ["Head & more", "First para graph here", "Second <p> é", "one", "two"]


def test_classes_hide_no_article():
    for page in ('<article class="post tag-social"><h1>A</h1><p>b</article>', '<div class="layout has-sidebar"><article><h1>A</h1><p>b</article></div>', '<article><div class="entry-header"><h1>A</h1></div><p>b</article>', '<div class="sidebar-layout"><div class="ad">x</div><article><h1>A</h1><p>b</article></div>', '<article><div class="header"><h1>A</h1><p>x</div><p>b</article>', '<article class="notice alert"><h2 class="social">A</h2><p>b</article>', '<div class="search"><main><h1>A</h1><p>b</main></div>'):
        assert pagediff.blocks(f"<body><nav>Menu</nav>{page}<footer>z</footer></body>") == (["A", "b"], True), page
    # what holds comments or other pages' articles stays hidden beside the page's own
    assert pagediff.blocks('<div class="related"><article><h1>C</h1></article></div><article><p>b<article class="comment">no</article></article>') == (["b"], True)
    assert pagediff.blocks('<aside class="x"><article>C</article></aside><p>b')[0] == ["b"]


def test_broken_pages():
    assert pagediff.blocks(None) == ([], False) and pagediff.blocks("") == ([], False)
    assert pagediff.blocks("<article><h1>A</h1><p>b &am") == (["A", "b &am"], True)
    assert pagediff.blocks("<p>x<!-- y")[0] == ["x"]
    assert pagediff.blocks("a < b <3 <p>c")[0] == ["a < b <3", "c"]
    assert pagediff.blocks("<script>never ends <p>z") == ([], False)
    assert pagediff.blocks("<article><p>x</div></span><p>y</article><p>z")[0] == ["x", "y"]
    assert pagediff.blocks("<div>" * 3000 + "deep")[0] == ["deep"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_lines(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    found = pagediff.common_lines(a, b)
    assert len(found) == table[-1][-1]
    rest = iter(b)
    assert all(any(y == a[i] for y in rest) for i in sorted(found))


def test_differencing(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(40):
        host = "a.com" if i < 25 else f"h{i % 3}.org"
        own = [f"<p>text {i} {rng.random()}</p>" for _ in range(3)]
        rows.append((i, f"http://{host}/d/{i:02d}", f"<div>Home {host}</div><div>News {host}</div>{''.join(own)}<div>Imprint {host}</div>", 1))
        want[i] = "\n\n".join(x[3:-4] for x in own)
    rows.append((90, "http://a.com/d/00", rows[0][2], 1))  # a copy
    want[90] = want[0]
    rows += [(100, None, None, 1), (101, None, "<p>alone</p>", 1), (102, "http://a.com/d/03b", ARTICLE, 1)]
    want |= {100: "", 101: "alone", 102: "\n\n".join(pagediff.blocks(ARTICLE)[0])}
    got = pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert pagediff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mirrors_under_other_paths_lose_their_furniture(spark):
    def page(own):
        return "<div>Home</div><div>News</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>Imprint</div>"

    mirrored = [f"mirror {k}" for k in range(6)]
    rows = [(i, f"http://a.com/m/{i:02d}", page(mirrored)) for i in range(12)]
    rows += [(20 + i, f"http://a.com/z/{i:02d}", page([f"text {i} {k}" for k in range(6)])) for i in range(4)]
    got = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(mirrored if i < 20 else [f"text {i - 20} {k}" for k in range(6)]) for i, *_ in rows}


def test_differencing_decides_on_marked_articles(spark):
    def page(own):
        return f"<nav>Menu</nav><article><h1>{own[0]}</h1><p>Follow us everywhere</p>{''.join(f'<p>{x}</p>' for x in own[1:])}<p>All rights reserved by us</p></article>"

    texts = {i: [f"head {i}", *(f"text {i} {k}" for k in range(4))] for i in range(8)}
    texts[2][3] = texts[3][3] = "a sentence that two articles share"
    rows = [(i, f"http://a.com/d/{i}", page(x)) for i, x in texts.items()]
    rows.append((9, "http://a.com/d/9", "<article><p>Follow us everywhere</p></article>"))
    texts[9] = ["Follow us everywhere"]  # never deleted whole
    rows += [(20 + i, f"http://b.com/d/{i}", page(texts[i])) for i in range(2)]  # too few pages to tell
    # five of 14 pages in a row share a line: text, as most pages of the host don't hold it
    texts |= {50 + i: [f"h {i}", *(f"long {i} {k}" for k in range(4)), *(["said again"] if i < 5 else [])] for i in range(14)}
    rows += [(50 + i, f"http://d.com/d/{i:02d}", f"<article>{''.join(f'<p>{x}</p>' for x in texts[50 + i])}</article>") for i in range(14)]
    versions = {30 + i: ["v", "one", "two", "three", "four", f"own {i}"] for i in range(6)}
    rows += [(i, f"http://c.com/d/{i}", page(x)) for i, x in versions.items()]
    whole = lambda x: "\n\n".join([x[0], "Follow us everywhere", *x[1:], "All rights reserved by us"])
    want = {i: "\n\n".join(x) for i, x in texts.items()} | {20 + i: whole(texts[i]) for i in range(2)} | {i: whole(x) for i, x in versions.items()}
    got = pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
