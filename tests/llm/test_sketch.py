import hashlib
import random
import re

from pyspark.sql import functions as F

from conftest_llm import doc
from scriptorium.llm import sketch
from scriptorium.llm.common import WORD


def shingles(text):
    words = re.findall(WORD, text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_match_brute_force(spark, frame):
    rng = random.Random(3)
    rows = [doc(i * 3, " ".join(rng.choice(("é", "a", "bb", "c\t", "d\n", "🙂")) + str(rng.randrange(60)) for _ in range(rng.choice((0, 1, 4, 5, 40, 900))))) for i in range(60)]
    rows += [doc(6, rows[2][1]), doc(None, None), doc(-4, "x y z")]
    got = sketch.edits(frame(rows)).withColumn("e", sketch.resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("f", sketch.resemblance(F.col("sketch"), F.col("next_sketch"))).collect()
    assert len(got) == len(rows)
    units = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for (i, text), (_, after) in zip(units, [*units[1:], units[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[i, len(text)] = edited, jaccard(text, edited), jaccard(text, after)
    for r in got:
        edited, e, f = want[r.doc_id, r.n_chars]
        assert r.edited_text == edited and hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.e - e) < 0.15 and abs(r.f - f) < 0.15
    assert sketch.edits(frame([])).count() == 0
    alone = sketch.edits(frame([doc(1, "abcd")])).first()
    assert alone.edited_text == "abab"


def test_estimates(spark):
    rng = random.Random(4)
    words = ["w%d" % rng.randrange(10**6) for _ in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:2000])), (3, " ".join(words[2000:]))]
    df = sketch.with_sketch(spark.createDataFrame(rows, "id int, text string"), "text", "s")
    a, b, c = (df.filter(f"id = {i}").select(F.col("s").alias(f"s{i}")) for i in (1, 2, 3))
    r = a.crossJoin(b).crossJoin(c).select(sketch.distinct(F.col("s1")).alias("d"), sketch.containment(F.col("s2"), F.col("s1")).alias("k"), sketch.containment(F.col("s1"), F.col("s2")).alias("l"), sketch.resemblance(sketch.merge(F.col("s2"), F.col("s3")), F.col("s1")).alias("m")).first()
    assert abs(r.d / 3996 - 1) < 0.3 and r.k > 0.8 and 0.3 < r.l < 0.7 and r.m > 0.95
    merged = sketch.merge_all(df.filter("id > 1").withColumn("g", F.lit(1)), ["g"], "s").select(F.col("s").alias("m"))
    assert merged.crossJoin(a).select(sketch.resemblance(F.col("m"), F.col("s1")).alias("x")).first().x > 0.95
