import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest_llm import doc
from scriptorium.llm import ngrams
from scriptorium.llm.common import Scratch
from scriptorium.llm.eliasfano import EliasFano, load, save


@settings(max_examples=150, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 40), st.integers(0, 2**64 - 2)), max_size=60), st.lists(st.integers(0, 2**64 - 2), max_size=5))
def test_elias_fano(values, others):
    own = np.array(sorted(values), np.uint64)
    coded = EliasFano.build(own)
    assert coded.values().tolist() == own.tolist()
    assert coded.find(own).tolist() == list(range(len(own)))
    rest = np.array([x for y in (*values, *others) for x in (y, y + 1) if x not in values], np.uint64)
    assert (coded.find(rest) == -1).all()


def test_elias_fano_is_compact(tmp_path):
    values = np.unique(np.random.default_rng(1).integers(0, 2**40, 200_000, dtype=np.uint64))
    coded = EliasFano.build(values)
    assert sum(a.nbytes for a in coded.arrays("x").values()) * 8 / len(values) < 2 + 40 - math.log2(len(values)) + 4
    save(str(tmp_path / "f"), coded.arrays("x") | {"y": np.arange(5, dtype=np.uint8)})
    back = load(str(tmp_path / "f"))
    assert EliasFano.of(back, "x").find(values[::7]).tolist() == list(range(0, len(values), 7)) and back["y"].tolist() == [0, 1, 2, 3, 4]


def brute(rows, k):
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    train = [split(r[1]) for r in rows if ngrams.crc_fold(r[0])]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([b"", *t], t))
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for r in rows:
        t = split(r[1])
        s = sum(math.log10((pairs[a, b] + k * base(b)) / (c[a] + k)) if c[a] else math.log10(base(b)) for a, b in zip([b"", *t], t))
        out.append((r[0], not ngrams.crc_fold(r[0]), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), s))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_match_brute_force(spark, frame, monkeypatch, small):
    if small:  # several shards, split contexts and blocks; the values reach the workers with the functions that hold them
        monkeypatch.setattr(ngrams, "WORDS_A_SHARD", 20)
        monkeypatch.setattr(ngrams, "TOKENS_A_SHARD", 400)
    rng = random.Random(4)
    word = lambda: ("the", "of", "É")[rng.randrange(3)] if rng.random() < 0.5 else "W%d" % int(rng.paretovariate(0.7))
    rows = [doc(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [doc(i + 1000, rows[i][1]) for i in range(0, 60, 4)] + [doc(None, None), doc(3, rows[3][1]), doc(5000, ""), doc(5001, "unseen words only")]
    docs = frame(rows)
    model = ngrams.train(docs.filter(ngrams.training()), Scratch(spark, "t"))
    assert small == (model.shards > 1) and small == bool(len(model.sizes) > 1)
    got = ngrams.fit_and_score(docs).collect()
    key = lambda r: (str(r[0]), r[2])
    rows_of = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(rows_of, sorted(brute(rows, model.k), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 0.05 * a[2], (a, b)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up(spark, frame):
    rows = [doc(i, "a b a c b a d"[: 2 * i + 1]) for i in range(1, 7)]
    model = ngrams.train(frame(rows), Scratch(spark, "t"))
    words = model.numbers(ngrams._digest([b"a", b"b", b"c", b"d", b""]))
    counts = model.counts(words)
    for i in range(5):
        p = 10 ** model.logs(np.full(5, i), np.arange(5), words, counts)
        assert abs(p.sum() + model.k * 0.1 / (model.total + 0.1 * 6) / (counts[i] + model.k) - 1) < 0.02


def test_nothing_to_learn_from(spark, frame):
    assert ngrams.fit_and_score(frame([])).count() == 0
    r = ngrams.fit_and_score(frame([doc(None, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
