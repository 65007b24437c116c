"""Literal cases, worked out by hand, of the text functions and measurements."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.operators import features, integrity, scoring


def one(spark, column, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("column", "values", "want"),
    [
        (lambda: T.word_count(F.col("c0")), ("  a\tb\n c ",), 3),
        (lambda: T.word_count(F.col("c0")), ("",), 0),
        (lambda: T.sentences(F.col("c0")), ("One. Two!  Three? four",), ["One.", "Two!", "Three?", "four"]),
        (lambda: T.sentences(F.col("c0"), ".!?।॥"), ("एक। दो॥ तीन",), ["एक।", "दो॥", "तीन"]),
        (lambda: T.literal_count(F.col("c0"), "aa"), ("aaaaa",), 2.0),
        (lambda: T.script_share(F.col("c0"), "Devanagari"), ("abc 12",), 0.0),
        (lambda: T.script_share(F.col("c0"), "Devanagari"), ("12",), 0.0),
        (lambda: T.script_share(F.col("c0"), "Klingon"), ("abc",), 1.0),
        (lambda: T.ascii_digits(F.col("c0")), ("५०० ৩",), "500 3"),
        (lambda: T.slug(F.col("c0")), ("Früh & Spät: 10 Signs!",), "fruh-spat-10-signs"),
        (lambda: T.slug(F.col("c0")), ("हिन्दी",), "untitled"),
        (lambda: T.serp_cut(F.col("c0"), 5), ("abc defg",), "abc…"),
        (lambda: T.chunk_sentences(F.col("c0"), 12), ("One two. Three. A much longer one. B.",), ["One two.", "Three.", "A much longer one.", "B."]),
        (lambda: T.syllables(F.col("c0")), ("banana",), 3),
        (lambda: T.syllables(F.col("c0")), ("the",), 1),
        (lambda: T.is_question(F.col("c0")), ("What is it",), True),
        (lambda: T.is_question(F.col("c0")), ("Whatever it is",), False),
        (lambda: T.is_question(F.col("c0")), ("यह क्या है",), False),
        (lambda: T.is_question(F.col("c0")), ("यह कौन है",), True),
        (lambda: T.token_set(F.col("c0"), L.SITE_STOP), ("The 10 Best Signs of Kidney kidney pain",), ["kidney", "pain"]),
        (lambda: integrity.numbers(F.col("c0")), ("Q1. take 0500 mg, 1,000 or 2.5",), ["1000", "2.5", "500"]),
    ],
)
def test_functions(spark, column, values, want):
    assert one(spark, column(), *values) == want


@pytest.mark.parametrize(("value", "good", "bad", "want"), [(0.8, 0.8, 0.35, 100), (0.2, 0.8, 0.35, 0), (0.0, 0.0, 5.0, 100), (2.5, 0.0, 5.0, 50), (1.0, 3.0, 3.0, 100)])
def test_norm(spark, value, good, bad, want):
    assert abs(spark.range(1).select(T.norm(F.lit(value), good, bad).alias("x")).first().x - want) < 1e-9


def test_english_features(spark):
    text = "Moreover, it was created quickly. In order to grow, we delve into it. Here is why: speed, cost, and care.\nA short line here now."
    row = features.english(spark.createDataFrame([(text,), (None,)], "text string")).orderBy(F.desc("words")).collect()
    r, empty = row
    assert r.words == 25 and r.n_sents == 4
    assert r.filler_1k == round(1 / 0.025, 2) and r.tell_1k == round(2 / 0.025, 2) and r.colon_lists_1k == round(1 / 0.025, 2)
    assert r.passive_ratio == 0.25
    assert empty.words == 1 and empty.n_sents == 0 and empty.ttr == 0 and empty.sent_cv == 0


def test_hindi_features(spark):
    text = "यह घर है। वह जोर से बोला था। राम के रूप में आया , और गया है।"
    r = features.hindi(spark.createDataFrame([(text,)], "text string")).first()
    assert r.purity == 1.0 and r.danda_frac == 1.0
    assert r.rel_1k == round(1 / (r.words / 1000), 2)  # met inside a longer word, as the boundary has it
    assert r.prep_calque_1k == round(1 / (r.words / 1000), 2) and r.sp_punct_1k == round(1 / (r.words / 1000), 2)
    r = features.hindi(spark.createDataFrame([("वह जो है, जोर",)], "text string"), linguistic=True).first()
    assert r.rel_1k == 250.0


def test_scores(spark):
    df = spark.createDataFrame([("यह घर है। " * 3,), ("english only words here",)], "text string")
    good, bad = scoring.grammar(df).orderBy("text").collect()[::-1]
    assert good.grammar > 90 and bad.grammar < 70 and [f.kind for f in bad.flags][0] == "mixed_script"
    r = scoring.register(spark.createDataFrame([("आप आप तुम तू",)], "text string")).first()
    assert r.dominant == "formal" and r.consistency == 0.5 and [f.kind for f in r.flags] == ["honorific_mix"]
    r = scoring.translationese(spark.createDataFrame([("राम के रूप में " * 5,)], "text string")).first()
    assert {"prep_calque"} <= {f.kind for f in r.flags} and r.translationese < 70
    row = spark.createDataFrame([(90.0, 80.0, 70.0, 60.0, 50.0, 75.0, [("hedge_lost", "error"), ("calque", "warn")])], ", ".join(f"{k} double" for k in L.COMPOSITE_WEIGHTS) + ", flags array<struct<kind:string,severity:string>>")
    r = scoring.brief(scoring.composite(row), 1).first()
    assert r.human_likeness == round(90 * 0.2 + 80 * 0.22 + 70 * 0.28 + 60 * 0.08 + 50 * 0.14 + 75 * 0.08, 1)
    assert not r.passed and r.brief == ["[error] hedge_lost"]


def test_integrity(spark):
    df = spark.createDataFrame([(1, "500 mg dose under supervision. Consult a doctor. Call 9876543210, Rs. 1,000 or 5%", "50 mg dose cures, guaranteed. Call 9876543210, Rs 1000 or 5 %")], "id int, s string, t string")
    r = integrity.number_diff(df, "s", "t").first()
    assert r.invented == ["50"] and r.dropped == ["500"]
    r = integrity.guard(df, "s", "t").first()
    assert r.new_claims == ["cure", "guaranteed"] and r.hedge_lost
    got = {(r.kind, r.value, r.issue) for r in integrity.protected_diff(df, "s", "t", ["id"]).collect()}
    assert got == {("dosage", "500mg", "dropped"), ("dosage", "50mg", "invented")}
    assert integrity.number_diff(df, "s", "s").first().invented == []
    assert integrity.fix_verdict(df, "s", "t").first().verdict == "blocking"
    arrays = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a"]), (["a"], ["b"])], "x array<string>, y array<string>")
    assert [r.accepted for r in integrity.regression_accepted(arrays, "x", "y").collect()] == [True, False, False]
