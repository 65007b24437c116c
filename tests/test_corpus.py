import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import corpus, ranks, similarity
from scriptorium.sources import html
from scriptorium.streaming import ledger


def test_auc_and_median(spark):
    pos, neg = [3, 4, 4, 7], [1, 4, 5]
    df = spark.createDataFrame([(x, True) for x in pos] + [(x, False) for x in neg], "v int, p boolean")
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 12
    assert corpus.auc(df, "v", F.col("p")).first().auc == round(want, 6)
    for values in ([5], [1, 2], [3, 1, 2], [4, 4, 1, 9]):
        assert corpus.upper_median(spark.createDataFrame([(v,) for v in values], "v int"), "v").first().median == sorted(values)[len(values) // 2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.sampled_from("abcdef"), min_size=1), min_size=1, max_size=8))
def test_f1_pairs(spark, sets):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, tokens array<string>")
    got = {(r.a, r.b) for r in similarity.f1_pairs(df, "id", "tokens", 0.72).collect()}
    first = {i: min(j for j, t in enumerate(sets) if t == s) for i, s in enumerate(sets)}
    want = {(i, j) for i in first.values() for j in first.values() if i < j and 2 * len(sets[i] & sets[j]) / (len(sets[i]) + len(sets[j])) >= 0.72}
    assert got == want | {(f, i) for i, f in first.items() if i != f}


def test_best_match(spark):
    q = spark.createDataFrame([(1, ["thyroid", "symptoms"]), (2, ["nothing", "alike"]), (3, ["kidney", "diet"])], "q int, tokens array<string>")
    e = spark.createDataFrame([(10, ["thyroid", "cancer", "symptoms"]), (11, ["kidney", "diet"]), (12, ["kidney", "diet"])], "e int, tokens array<string>")
    got = {r.q: (r.status, r.match, r.score) for r in similarity.best_match(q, e, "q", "e").collect()}
    assert got == {1: ("partial", 10, 0.8), 2: ("gap", None, 0.0), 3: ("covered", 11, 1.0)}


def test_pages(spark):
    page = """<html lang="en"><head><title> A &amp; B </title><meta name="description" content="d"><script>var x="<p>no</p>"</script></head><body><nav><a href="/x/">n</a></nav>
<h1>A</h1><p>One <b>two</b></p><p>One <b>two</b></p><h2>Why?</h2><ul><li>x y</ul><p>.</p><img src="a.jpg"><img alt="t" src="b"><a href="#f">f</a><a href="http://www.h.com/y#z">y</a></body></html>"""
    rows = html.page_rows(spark.createDataFrame([(1, "http://h.com/a/b.html?q", page), (2, None, None)], "page_id int, url string, html string")).orderBy("page_id").collect()
    r = rows[0]
    assert (r.title, r.description, r.lang, r.h1, r.h2, r.images, r.images_no_alt) == ("A & B", "d", "en", ["A"], ["Why?"], 2, 1)
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [(b.pos, b.type, b.text) for b in html.block_rows(df, "page_id").orderBy("pos").collect()] == [(0, "p", "One two"), (1, "h2", "Why?"), (2, "li", "x y")]
    links = corpus.link_rows(html.page_rows(spark.createDataFrame([(1, "http://h.com/a/b.html?q", page)], "page_id int, url string, html string"))).collect()
    assert {(x.target, x.internal) for x in links} == {("http://h.com/x", True), ("http://www.h.com/y", True)}


def lines():
    rows = [{"key": f"s{i % 3}::hi", "status": s, "ts": float(-i), "passes": i} for i, s in enumerate(["pending", "translated", "published", "failed", "published"])]
    return [json.dumps(r) for r in rows] + ["", '{"key": "torn', json.dumps({"key": "x", "status": "scored", "more": 1})]


def test_ledger_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "ledger"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(lines()) + "\n")
    rows = ledger.read(spark, str(folder)).withColumn("seq", F.col("passes"))
    assert rows.count() == 6
    batch = {(r.key, r.status) for r in ledger.state(rows.filter("seq is not null")).collect()}
    assert batch == {("s0::hi", "failed"), ("s1::hi", "published"), ("s2::hi", "published")}
    wanted = spark.createDataFrame([("s0::hi",), ("s1::hi",), ("new",)], "key string")
    assert {r.key for r in ledger.pending(wanted, ledger.state(rows)).collect()} == {"s0::hi", "new"}
    stream = spark.readStream.schema(ledger.RECORD).json(str(folder)).filter("key is not null and passes is not null").withColumn("seq", F.col("passes"))
    kept, query = ledger.stream_state(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert {(r.key, r.status) for r in kept.state().collect()} == batch


def test_running_sums_by_ranges(spark):
    """Against a sum row by row: few and many ranges, a hot range, nulls, negative values, an empty table."""
    values = [None, -7, -3, 0, *range(5, 400, 3), 10**12]
    rows = [(v, i % 7, None if i % 11 == 0 else i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v long, a int, b long").repartition(3)
    want, a, b = {}, 0, 0
    for v, x, y in rows:
        want[v], a, b = (a, b), a + x, b + (y or 0)
    for ranges in (2, 200):
        got = ranks.running(df, "v", {"below_a": "a", "below_b": "b"}, ranges).collect()
        assert {r.v: (r.below_a, r.below_b) for r in got} == want and len(got) == len(rows)
    assert ranks.running(df.limit(0), "v", {"below": "a"}).count() == 0
    assert corpus.upper_median(df.limit(0), "v").first().median is None
    assert corpus.upper_median(spark.createDataFrame([(0.5,), (0.25,), (float("nan"),)], "v double"), "v").first().median == 0.5
