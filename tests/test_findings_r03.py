"""What the third review found: results that differed from their SQL."""

import math
import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

from scriptorium.functions import text as T
from scriptorium.operators import answers, articles, corpus, features, findings, integrity, keywords, similarity
from scriptorium.streaming import state


def test_rounding_goes_by_the_multiple(spark):
    # 502.49999999999994 and 608.5 are what these are as doubles, times 1000 and 10
    row = spark.range(1).select(T.rounded(F.lit(0.5025), 3).alias("a"), T.rounded(F.lit(60.849999999999994), 1).alias("b"), T.rounded(F.lit(2.5), 0).alias("c")).first()
    assert tuple(row) == (0.502, 60.9, 3.0)


def test_titles_begin_with_one_capital(spark):
    rows = spark.createDataFrame([(1, 1, "ß üß ererte. Entestbe, der", "gap"), (1, 2, "ǆ of a title that is long", "gap"), (1, 3, "ŉ of a title that is long", "gap")], "id long, pos long, query string, status string")
    assert [r.title[0] for r in keywords.title_options(rows, "id").orderBy("k").collect()] == ["ẞ", "Ǆ", "ŉ"]


def test_a_link_of_one_address_counts_once(spark):
    pages = spark.createDataFrame([("https://a.org/1", ["/x", "/y"]), ("https://a.org/1", ["/x"]), ("https://a.org/2", ["/x"])], "url string, links array<string>")
    assert sorted((r.url[-1], r.target[-1]) for r in corpus.link_rows(pages).collect()) == [("1", "x"), ("1", "y"), ("2", "x")]


def test_suggestions_of_pages_with_one_address_are_not_summed(spark):
    pages = spark.createDataFrame([("https://a.org/1", "kidney stones diet"), ("https://a.org/2", "kidney stones pain"), ("https://a.org/2", "kidney stones today")], "url string, title string")
    none = spark.createDataFrame([], "url string, target string")
    found = articles.link_suggestions(pages, none, none.groupBy("target").agg(F.count("*").alias("n")))
    assert sorted((r.source[-1], r.shared, r.score, r.k) for r in found.filter("target like '%1'").collect()) == [("2", 2, 0.67, 1), ("2", 2, 0.67, 2)]


def test_an_answer_goes_to_the_very_heading(spark):
    block = "array<struct<type:string,text:string>>"
    rows = spark.createDataFrame([(1, "T", "D", [("h3", "One "), ("p", "a"), ("h3", "One")], [], []), (2, "T", "D", [("h3", "One ")], [], [])], f"id int, title string, meta_description string, blocks {block}, faqs array<struct<q:string,a:string>>, images array<struct<src:string,alt:string>>")
    plan = f"id int, title string, meta_description string, tldr array<string>, tldr_heading string, answers map<string,string>, blocks {block}, faqs array<struct<q:string,a:string>>, images_alt map<string,string>"
    plans = spark.createDataFrame([(1, None, None, None, None, {"One ": "Yes."}, None, None, None), (2, None, None, None, None, {"One": "Yes."}, None, None, None)], plan)
    one, two = answers.apply_structure(rows, plans, "id").orderBy("id").collect()
    assert [b.text for b in one.blocks] == ["One ", "Yes.", "a", "One"]
    assert [b.text for b in two.blocks] == ["One ", "Yes."]


def test_the_last_millisecond_waits(spark, tmp_path):
    """A row of the watermark's own millisecond that comes later is met in order, too."""
    start, schema, folder = datetime(2024, 1, 1), "user string, ts timestamp, id long", str(tmp_path / "in")
    at = lambda us: start + timedelta(microseconds=us)
    runs = []
    for part in ([("a", at(100), 1), ("a", at(5_000_702), 3)], [("a", at(5_000_300), 2), ("b", at(9_000_000), 4)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        rows = state.throttled(stream, "user", "ts", "id", F.lit(True), 60, 3, "0 seconds")
        runs.append(sorted((r.id, r.recent) for r in state.drained(rows, str(tmp_path / "out"), str(tmp_path / "check")).collect()))
    assert runs == [[(1, 1)], [(1, 1), (2, 2), (3, 3)]]


def test_frequent_tokens_meet_small_entries_only(spark):
    """Best matches equal all comparisons with entries of up to 80 tokens, and large entries of a frequent token alone are not met."""
    rng = random.Random(5)
    words = [f"w{int(rng.random() ** 3 * 300)}" for _ in range(5000)]
    index = [set(rng.sample(words, rng.choice([1, 2, 3, 5, 8, 20, 80]))) for _ in range(300)] + [{"the", *(f"x{i}.{j}" for j in range(30))} for i in range(200)]
    asked = [set(rng.sample(words, rng.randint(1, 9))) for _ in range(100)] + [{"the", f"y{i}", f"z{i}"} for i in range(50)]
    q = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(asked)], "q long, tokens array<string>")
    e = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(index)], "e long, tokens array<string>")
    got = {r.q: (r.match, r.score, r.status) for r in similarity.best_match(q, e, "q", "e").collect()}
    for i, s in enumerate(asked):
        score, entry = max(((2 * len(s & t) / (len(s) + len(t)), -j) for j, t in enumerate(index) if s & t), default=(0.0, 0))
        status = "covered" if score >= 0.85 else "partial" if score >= 0.45 else "gap"
        assert got[i] == (-entry if score >= 0.3 else None, math.floor(score * 100 + 0.5) / 100, status), i
    assert {r.q: r.status for r in similarity.statuses(q, e, "q", "e").collect()} == {i: r[2] for i, r in got.items()}
    _, _, sets, entries = similarity._indexed(q.filter("q >= 100"), e, "q", "e")
    assert similarity.nearest(sets.withColumn("_least", F.lit(0.45)), entries, "_q", "_e").count() == 0


def test_suggestions_are_not_sent_whole(spark):
    topics = spark.createDataFrame([("kidney",), ("liver",)], "topic string")
    asked = keywords.queries_of(topics, "topic")
    found = keywords.suggested(asked, asked.select("query", F.concat("query", F.lit(" today")).alias("suggestion")), "topic")
    assert found.count() > 10 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_frequent_terms_are_counted_without_a_shuffle(spark):
    texts = ["Beta alpha beta, gamma_alpha ab cd the1 BETA delta", "", None, "this that " * 3 + "zeta"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(T.frequent_terms(F.col("text"), ["this"], 3, 3).alias("t"))
    assert [[tuple(x) for x in r.t] for r in rows.collect()] == [[("beta", 3), ("alpha", 2), ("gamma", 1)], [], [], [("that", 3), ("zeta", 1)]]
    queries = __import__("__spark_entry__").queries()
    assert "Exchange" not in queries["c18_secondary_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_spans_are_made_piece_after_piece():
    seen = []
    out = integrity._pieces(lambda a, b: (seen.append(len(a)), [x + y for x, y in zip(a, b, strict=True)])[1], pa.int64(), pa.array(range(1000)), pa.array([1] * 1000))
    assert out.to_pylist() == list(range(1, 1001)) and max(seen) == integrity.PIECE
    assert integrity._pieces(lambda a: a, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_characters_are_counted_without_an_array(spark):
    rows = spark.createDataFrame([("aé𝒳 1-b",), ("",), ("12",)], "t string").select(T.characters(F.col("t"), r"\p{L}").alias("n"), T.characters(F.col("t"), r"[\x{0041}-\x{007A}&&\p{L}]").alias("latin"))
    assert [tuple(r) for r in rows.collect()] == [(4, 2), (0, 0), (0, 0)]
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_guard_reads_each_text_in_lower_case_once(spark):
    rows = integrity.guard(spark.createDataFrame([("It may cure", "Guaranteed")], "a string, b string").repartition(2), "a", "b")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(coalesce(") == 2
    assert rows.select("missing_terms", "new_claims", "hedge_lost").first() == ([], ["guaranteed"], True)


def test_openers_are_the_first_words_of_sentences_of_four_or_more(spark):
    rows = spark.range(1).select(F.array(F.lit("The Road  is long"), F.lit("One two three"), F.lit("A\tb c d e")).alias("s")).select(features.openers(F.col("s")).alias("o"))
    assert "regexp_extract(" not in rows._jdf.queryExecution().analyzed().toString()
    assert rows.first()["o"] == ["the road", "a b"]


def test_readiness_and_reach_shuffle_no_text(spark):
    queries = __import__("__spark_entry__").queries()
    for name in ("e29_reach", "e27_readiness", "i3_draft_chunks"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Join", "Aggregate", "hashpartitioning")), name


def test_terms_within_the_row_are_the_entities(spark):
    rng = random.Random(5)
    names = ["Anna", "Bob Bill", "Cara", "Dora", "The", "However", "Eve", "Long Name Of", "Zed Yon", *(f"N{x}me" for x in "abcdefghij")]
    rows = [(i, " ".join(rng.choice([f"{n}, and" for n in names]) for _ in range(n))) for i, n in enumerate((0, 1, 2, 5, 40, 400))] + [(9, None)]
    docs = spark.createDataFrame(rows, "id int, text string")
    want = {i: [] for i, _ in rows}
    for r in findings.entities(docs, "id").orderBy("id", "k").collect():
        want[r.id] += [r.entity.lower()] if len(r.entity) > 3 else []
    assert {r.id: r.terms for r in findings.with_terms(docs).collect()} == want and max(map(len, want.values())) > 8
