"""The pipeline's stages against brute-force versions of what each decides, on planted documents."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from scriptorium.llm import mixing, weaksup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n):
    words = [rng.choice(("the", "of", "and", "to", "in")) if rng.random() < 0.35 else "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 15]).capitalize() + "." for i in range(0, n, 15))


def planted():
    rng = random.Random(5)
    clean = {i: sentences(rng, rng.choice((60, 150, 400))) for i in range(60)}
    rows = dict(clean)
    passage = sentences(rng, 55).replace("\n", " ")
    near, copies, shared, junk = {}, {}, [], []
    for i in range(5):
        copies[100 + i] = i
        rows[100 + i] = clean[i]
        words = clean[10 + i].split(" ")
        words[len(words) // 2] = "changed"
        near[110 + i] = 10 + i
        rows[110 + i] = " ".join(words)
        shared.append(120 + i)
        rows[120 + i] = sentences(rng, 80) + "\n" + passage + "\n" + sentences(rng, 40)
        junk += [130 + i, 140 + i]
        rows[130 + i] = " ".join(f"{w}###" for w in sentences(rng, 60).split())
        rows[140 + i] = "a b c d e f " * 20
    return clean, rows, near, copies, shared, junk, passage


def test_stages(spark, tmp_path):
    clean, rows, near, copies, shared, junk, passage = planted()
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s%d" % (i % 4), len(t)) for i, t in rows.items()], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, outs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = outs[name] = spark.read.parquet(f"{folder}/{name}")
        assert name == "pack" or docs.columns == columns

    kept = {r.doc_id: r.text for r in outs["quality"].collect()}
    accuracy, share = weaksup.estimate(Counter(weaksup.measure(t)[len(weaksup.BASE) :] for t in rows.values()))
    for i, t in rows.items():
        m = weaksup.measure(t)
        weights, votes = weaksup.weight(accuracy), m[len(weaksup.BASE) :]
        logit = __import__("math").log(share / (1 - share)) + sum(w[0] if v > 0 else w[1] if v < 0 else 0 for v, w in zip(votes, weights))
        assert (i in kept) == (m[0] >= 10 and 100 * m[4] <= 20 * m[0] and logit >= 0)
    assert not set(junk) & set(kept) and set(clean) <= set(kept)

    single = {r.doc_id for r in outs["near_duplicates"].collect()}
    assert single == set(kept) - set(near) - set(copies)

    left = {r.doc_id: r for r in outs["repeats"].collect()}
    assert set(left) == single and all(left[i].n_chars == len(left[i].text) for i in left)
    assert all(passage not in left[i].text for i in shared)
    assert all(left[i].text == rows[i] for i in clean)

    mixed = Counter(r.doc_id for r in outs["mix"].collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, r in left.items():
        n = len(r.text.split())
        sizes[r.source] += n
        taken[r.source] += n * mixed[i]
    targets = {r._source: r.target for r in mixing.targets(spark.createDataFrame([(False, s, n) for s, n in sizes.items()], "_none boolean, _source string, source_size long"), mixing.Scratch(spark, "t")).collect()}
    longest = max(len(r.text.split()) for r in left.values())
    assert all(abs(taken[s] - t) <= longest for s, t in targets.items()) and max(mixed.values()) <= 2

    pieces = outs["pack"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.countDistinct("sequence_id", "offset").alias("places"), F.count("*").alias("rows")).collect()
    assert {r.doc_id for r in pieces} == set(mixed) and all(r.places == r.rows for r in pieces)
    assert outs["pack"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n > 1024 or end != n").count() == 0


def test_run_equals_the_stages(spark):
    folder = "/root/testdata/sf0.001"
    a = corpus_pipeline.run(spark, folder)
    assert a.count() > 100 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(a.columns)
