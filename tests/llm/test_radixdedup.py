import hashlib
import random
from collections import defaultdict

import pytest

from conftest_llm import doc
from scriptorium.llm import radixdedup as rd


def brute(texts, width):
    where = defaultdict(list)
    coded = [(t or "").encode() for t in texts]
    for i, b in enumerate(coded):
        for p in range(len(b) - width + 1):
            where[b[p : p + width]].append((i, p))
    gone = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + width))
    out = []
    for b, g in zip(coded, gone):
        n_spans = sum(x in g and x - 1 not in g for x in g)
        out.append((len(b), len(g), n_spans, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    common, long = text(60), text(400)
    texts = [text(rng.choice((0, 5, 40, 200))) for _ in range(12)]
    texts += [text(rng.randrange(50)) + common[: rng.randrange(30, 61)] + text(rng.randrange(50)) for _ in range(25)]
    texts += [long, long, long[:200] + "X" + long[200:], long[50:], long[:-30] + text(9), "Y" + long[100:180] * 2, "a" * 300, "ab" * 200 + text(30), text(20) * 12, None, ""]
    return texts


@pytest.mark.parametrize("small", [256, 3])
def test_matches_brute_force(spark, frame, monkeypatch, small):
    monkeypatch.setattr(rd, "BLOCK", 90)
    monkeypatch.setattr(rd.spans, "__defaults__", (rd.WIDTH, small))
    monkeypatch.setattr(rd.with_spans, "__defaults__", (rd.WIDTH, small))
    texts = corpus(small)
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(3, texts[3]), doc(None, "n" + texts[-9])]
    got = rd.report(frame(rows), 32).drop("text").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 32))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_anchors_of_equal_windows_are_equal():
    rng = random.Random(1)
    for _ in range(200):
        width = rng.choice((16, 33, 64))
        alphabet = rng.choice((b"ab", bytes(range(97, 123))))
        shared = bytes(rng.choice(alphabet) for _ in range(width))
        found = []
        for _ in range(2):
            before = bytes(rng.choice(alphabet) for _ in range(rng.randrange(100)))
            places, hashes = rd.anchors(before + shared + bytes(rng.choice(alphabet) for _ in range(rng.randrange(100))), width)
            k, p = rd.anchor_width(width), len(before)
            found.append({(int(a) - p, int(h)) for a, h in zip(places, hashes) if p <= a <= p + width - k})
        assert found[0] & found[1]


def test_apply(spark, frame):
    passage = "".join(random.Random(2).choice("abcdefgh") for _ in range(80))
    rows = [(1, "héllo " + passage + " wörld", "en", "s", 9, "k"), (2, passage, "en", "s", 9, "k"), (3, "clean text", "en", "s", 9, "k"), (4, None, "en", "s", 9, "k")]
    for extra in ("c0", "_spans", "_id", "_hash"):
        docs = frame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra} string")
        out = rd.apply(docs, 60)
        assert out.columns == docs.columns
        assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("héllo  wörld", 12), 2: ("", 0), 3: ("clean text", 10), 4: (None, None)}
    assert rd.apply(frame([])).count() == 0
