"""What the fourth review found."""

import random
import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.operators import integrity, scoring
from scriptorium.plans import sql as S


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_opportunities_are_ranked_in_full_and_rounded_after(spark, tmp_path):
    """savings that are one when rounded keep their order; the ninth of a user goes, as does one of 100 milliseconds."""
    values = [(1, 7, 200.0000001), (2, 7, 200.0000004), (3, 7, 100.0), *((i, 8, 101.5) for i in range(4, 13))]
    d = _events(spark, tmp_path, values)
    found = [tuple(r) for r in __spark_entry__.queries()["e32_opportunities"](spark, d).orderBy("user_id", "k").collect()]
    assert found == [(7, 2, 200.0, 1), (7, 1, 200.0, 2), *((8, i, 101.5, i - 3) for i in range(4, 12))]


def test_vitals_are_rated_before_they_are_rounded(spark, tmp_path):
    """layout shift is rated by its thousandth, and a value that is one with its bound when rounded stays beyond it."""
    d = _events(spark, tmp_path, [(1, 7, 100.0), (2, 7, 10.0000000001), (7, 7, 100.0000001), (12, 8, None)])
    found = {r.event_id: (r.metric, r.value, r.rating) for r in __spark_entry__.queries()["e32_vitals"](spark, d).collect()}
    names = list(L.VITALS)
    assert found[1] == (names[1], 0.1, "good") and found[7] == (names[1], 0.1, "needs work")
    assert found[2] == (names[2], 200.0, "needs work") and found[12] == (names[0], None, "poor")


def test_weights_go_before_the_hundred(spark):
    """of sixteen words eleven are kept, which is 49.25 by the SQL's order of products and a bit less by another."""
    words = [f"word{chr(97 + i)}" for i in range(16)]
    rows = spark.createDataFrame([(" ".join(words + ["or"] * 20), " ".join(words[:11]))], "a string, b string")
    row = integrity.fidelity(rows, "a", "b", L.OVERLAP_STOP).first()
    assert (row.overlap, row.fidelity) == (0.688, 49.3)
    made = duckdb.connect().execute(f"SELECT round(0.55::DOUBLE * {S.norm('v', 0.80, 0.35)} + 8.0::DOUBLE, 1) FROM (SELECT 11.0::DOUBLE / 16 AS v)").fetchone()
    assert made == (49.3,)


def _syllables(text):
    """The same rule, word by word."""
    total = 0
    for w in re.findall("[A-Za-z']+", text):
        w = re.sub("[^a-z]", "", w.lower())
        rest = re.sub("^y", "", re.sub("(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", w))
        total += (len(w) > 0 if len(w) <= 3 else max(1, len(re.findall("[aeiouy]{1,2}", rest))))
    return total


def test_texts_are_passed_over_by_what_patterns_begin_with(spark):
    """counts equal those word by word, and no pattern of the fix loop is tried at every character by a look behind."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeyudlst' \n.!?éİK") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["yes. hmm psst edes a", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    made = rows.select("i", T.syllables(F.col("t")).alias("n"), T.sentences(F.col("t")).alias("s"), T.literal_count(F.col("t"), "é").alias("é")).orderBy("i").collect()
    for r, t in zip(made, texts):
        assert (r.n, r.s, r["é"]) == (_syllables(t), [x for x in (s.strip() for s in re.split(r"(?<=[.!?])[ \n]+", t)) if x], t.count("é")), t
    plan = __spark_entry__.queries()["n7_fix_loop"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r", (\(\?<[!=][^,]*),", plan)


def test_forms_are_sought_before_what_stands_before_them(spark):
    """forms of address equal a count by places, and no pattern of the composite is tried at every character by a look behind."""
    said = ["आप", "आप आप", "आपआप आप", "xआप आप", "आप_ _आप (आप)", "आपको आप को", "1आप आप1", "जो जोर xजोर"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    word = re.compile(r"(?<![^\W_])(?<!_)आप(?![^\W_])(?!_)")
    made = rows.select("i", T.regex_count(F.col("t"), scoring._honorific("आप")).alias("n")).orderBy("i").collect()
    assert [r.n for r in made] == [len(word.findall(t)) for t in said]
    plan = __spark_entry__.queries()["e9_g15_composite"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r", (\(\?<[!=][^,]*),", plan)
