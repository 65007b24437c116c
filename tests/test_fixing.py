from pyspark.sql import functions as F

from scriptorium.operators import findings, fixing

TEXT = "Take 500 mg under supervision and consult a doctor. Google says so."
LONG = "\nThe road is long and the day is fine." * 40


VARIED = "\nYes. No. And who would have thought of it on such a day as this one, so fine and so long that nobody wished it to end at all?" * 12
#: Each case's answers: the first, the one after being told what was wrong, the less uniform one.
CASES = {
    "good": (TEXT + LONG, None, None),
    "invents": (TEXT + LONG + " 2031 it was.",) * 2 + (None,),
    "claims": (TEXT + LONG + " A miracle.",) * 2 + (None,),
    "loses a name": ("Take 500 mg, and consult a doctor." + LONG,) * 2 + (None,),
    "loses the hedge": ("Take 500 mg. Google says so." + LONG,) * 2 + (None,),
    "second": (TEXT + " 97", "Take it under supervision and consult a doctor. Google says so." + LONG, None),
    "same": (TEXT, None, None),
    "nothing": (None, None, None),
    "nothing when told": (TEXT + " 97", None, None),
    "varied wrongly": (TEXT + LONG, None, TEXT + LONG + " 97"),
    "varied and shorter": (TEXT + LONG, None, TEXT),
    "varied": (TEXT + LONG, None, TEXT + LONG + VARIED),
}


def writer(rows, text, told, name):
    return rows.withColumn(name, F.when(F.col(text).isNotNull(), F.when(F.size(told) > 0, F.col("second")).otherwise(F.col("first"))))


def humaniser(rows, text, told, name):
    return rows.withColumn(name, F.when(F.col(text).isNotNull(), F.col("third")))


def test_each_end_of_the_loop(spark):
    df = spark.createDataFrame([(k, TEXT, *v) for k, v in CASES.items()], "case string, text string, first string, second string, third string")
    got = {r.case: r for r in fixing.fix(df, writer, humaniser).collect()}
    r = got["good"]
    assert (r.applied, r.reason, r.tried, r.fixed, r.blocking, r.review, r.humanised) == (True, None, 1, TEXT + LONG, [], [], False)
    assert r.after > r.before and r.ai_likeness is not None
    for case, why in (("invents", "invented:2031"), ("claims", "new_claims:miracle"), ("loses a name", "missing_terms:Google"), ("loses the hedge", "hedge_lost")):
        r = got[case]
        assert (r.applied, r.reason, r.tried, r.fixed, r.blocking, r.after, r.ai_likeness) == (False, "safety", 2, TEXT, [why], None, None), case
    r = got["second"]
    assert (r.applied, r.tried, r.review, r.blocking) == (True, 2, ["dropped:500"], [])
    r = got["same"]
    assert (r.applied, r.reason, r.fixed, r.after == r.before) == (False, "no_improvement", TEXT, True)
    assert (got["nothing"].reason, got["nothing"].tried) == ("pending", 0)
    # what blocked the first stays where the writer gives nothing when told
    r = got["nothing when told"]
    assert (r.reason, r.tried, r.blocking) == ("safety", 1, ["invented:97"])
    for case in ("varied wrongly", "varied and shorter"):
        assert (got[case].applied, got[case].humanised, got[case].fixed) == (True, False, TEXT + LONG), case
    r = got["varied"]
    assert r.after >= got["good"].after and r.ai_likeness <= got["good"].ai_likeness and r.humanised == (r.fixed != TEXT + LONG)


def test_odd_rows(spark):
    """Null and empty texts, repeated rows, an empty table, and columns named like the answers."""
    rows = [(1, None, "x"), (2, "", "x"), (3, TEXT, "x"), (3, TEXT, "x")]
    df = spark.createDataFrame(rows, "id int, text string, fixed string")

    def longer(rows, text, told, name):
        return rows.withColumn(name, F.concat(F.col(text), F.lit(LONG)))

    got = fixing.fix(df, longer).orderBy("id").collect()
    assert [(r.id, r.applied, r.reason, r.fixed) for r in got] == [(1, False, "pending", None), (2, True, None, LONG), (3, True, None, TEXT + LONG), (3, True, None, TEXT + LONG)]
    assert fixing.fix(df.limit(0), longer).count() == 0


def test_provider_is_told_what_blocked(spark):
    def answer(texts):
        for t in texts:
            yield None if t is None else TEXT + LONG if "- invented:97" in t else TEXT + " 97"

    df = spark.createDataFrame([(1, TEXT), (2, None)], "id int, text string")
    got = {r.id: (r.applied, r.tried) for r in fixing.fix(df, fixing.by(answer)).collect()}
    assert got == {1: (True, 2), 2: (False, 0)}


def test_score_of_equals_roll_up(spark):
    df = spark.createDataFrame([(1, TEXT), (2, TEXT + LONG), (3, ""), (4, None), (5, "Just a very good thing to do. " * 300)], "id int, text string")
    rolled = {r.id: r.score for r in findings.roll_up(findings.content(df, "id"), "id").collect()}
    assert rolled == {r.id: r.s for r in fixing.scored(df, "text", "s").collect()}
