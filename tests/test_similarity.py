import random

from scriptorium.operators import similarity


def f1(x, y):
    return 2 * len(x & y) / (len(x) + len(y))


def sets_of(rng, n, hot=True):
    words = [f"w{i}" for i in range(30)]
    return [{*rng.choices(words, [1 / (i + 1) for i in range(30)], k=rng.randrange(1, 9)), *(["the"] if hot and rng.random() < 0.9 else [])} for _ in range(n)]


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    sets = sets_of(rng, 150)
    df = spark.createDataFrame([(i, list(s), 1, "x") for i, s in enumerate(sets)] + [(900, [], 1, "x"), (901, [], 1, "x")], "id long, tokens array<string>, _n int, _token string")
    first = {i: min(j for j, t in enumerate(sets) if t == s) for i, s in enumerate(sets)}
    for least in (0.72, 0.5, 0.8, 1.0):
        got = {(r.a, r.b): r.f1 for r in similarity.f1_pairs(df, "id", "tokens", least).collect()}
        want = {(i, j): f1(sets[i], sets[j]) for i in set(first.values()) for j in set(first.values()) if i < j and f1(sets[i], sets[j]) >= least}
        want |= {(f, i): 1.0 for i, f in first.items() if i != f} | {(900, 901): 1.0}
        assert got == want


def test_best_matches_equal_all_comparisons(spark):
    rng = random.Random(3)
    asked, index = sets_of(rng, 80) + [{"unknown"}, set(), {"unknown", "w3"}], sets_of(rng, 120)
    q = spark.createDataFrame([(i, list(s)) for i, s in enumerate(asked)], "q long, tokens array<string>")
    e = spark.createDataFrame([(i, list(s)) for i, s in enumerate(index)] + [(500, [])], "e long, tokens array<string>")
    got = {r.q: (r.match, r.score, r.status) for r in similarity.best_match(q, e, "q", "e").collect()}
    for i, s in enumerate(asked):
        score, entry = max(((f1(s, t), -j) for j, t in enumerate(index) if s & t), default=(0.0, 0))
        status = "covered" if score >= 0.85 else "partial" if score >= 0.45 else "gap"
        assert got[i] == (-entry if score >= 0.3 else None, round(score + 1e-12, 2), status), i
    assert len(got) == len(asked)


def test_a_frequent_token_makes_no_pairs(spark):
    # 400 sets share two tokens; only those that share a rare one are compared
    rows = [(i, ["the", "of", f"a{i // 2}", f"b{i // 2}", f"c{i}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    ranked = similarity.in_order(df.withColumnRenamed("tokens", "_set"), "id", similarity.frequencies(df, "tokens"))
    met = similarity._prefixes(ranked, "id", "a", 0.72, []).join(similarity._prefixes(ranked, "id", "b", 0.72, []), "_token").filter("a < b").count()
    assert met <= 400  # of 79,800
    assert similarity.f1_pairs(df, "id", "tokens", 0.72).count() == 200


def greedy(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, out = set(), set()
    for n in sorted(near):
        if n not in taken:
            for m in near[n]:
                if m > n and m not in taken:
                    taken.add(m)
                    out.add((n, m))
    return out


def test_leaders_equal_a_greedy_pass(spark, tmp_path):
    rng = random.Random(4)
    for k in range(2):
        pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(50)}
        got = similarity.leaders(spark.createDataFrame(sorted(pairs) * 2, "a long, b long"), str(tmp_path / str(k))).collect()
        assert {(r.leader, r.member) for r in got} == greedy(pairs) and len(got) == len(greedy(pairs))
    assert similarity.leaders(spark.createDataFrame([], "a long, b long"), str(tmp_path / "none")).count() == 0


def test_a_long_chain_takes_few_rounds(spark, tmp_path):
    pairs = [(i, i + 1) for i in range(10_000)]
    got = similarity.leaders(spark.createDataFrame(pairs, "a long, b long"), str(tmp_path)).collect()
    assert {(r.leader, r.member) for r in got} == {(i, i + 1) for i in range(0, 10_000, 2)}
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("small")]) < 25
