import re

from scriptorium.llm import mixing

from conftest_llm import doc


def brute_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    caps, target, free = [2 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    rest = 1.5 * sum(sizes)
    while free:
        level = rest / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * level > caps[i]}
        if not over:
            for i in free:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = caps[i]
            rest -= caps[i]
        free -= over
    return target


def test_mix_matches_brute_force(spark, frame):
    rows = [doc(i, "w " * (i * 7 % 23), None if i % 5 == 0 else "s%d" % (i % 5)) for i in range(300)] + [doc(7, "w " * 3, "s2")] * 4 + [doc(None, None, "z"), doc(900, "", "y")]
    got = mixing.mix(frame(rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in sources]
    for s, total, target in zip(sources, sizes, brute_targets(sizes)):
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {total}
        assert all(abs(r.target - target) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 5
        assert all(r.taken <= 2 * r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(rows)).collect()))


def test_apply_keeps_columns_and_counts(spark, frame):
    rows = [(i, "w " * 10, "en", "s%d" % (i % 3), 20, "x") for i in range(90)]
    docs = frame(rows, "doc_id long, text string, lang string, source string, size long, taken string")
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    plan = mixing.mix(docs).groupBy("source").sum("taken").collect()
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    for r in plan:
        assert abs(counts[r.source] * 10 - r["sum(taken)"]) <= 10


def test_empty(spark, frame):
    assert mixing.mix(frame([])).count() == 0
    assert mixing.apply(frame([])).count() == 0
