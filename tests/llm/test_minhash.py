import random
import re

import numpy as np

from conftest_llm import doc
from scriptorium.llm import minhash
from test_simhash import closure

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    near = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    root = closure(list(range(len(rows))), near)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted((str(r[0]), len(s), str(least.get(root[i]) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets)))


def made(rng):
    rows = []
    for i in range(50):
        words = ["w%d" % rng.randrange(5000) for _ in range(rng.choice((1, 3, 4, 5, 40, 164, 164, 400)))]
        rows.append(doc(20 * i + 5, " ".join(words)))
        for k in range(i % 6):  # a changed word takes four shingles: chains around 0.8
            words = list(words)
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = f"new{i}x{k}x{rng.randrange(99)}"
            rows.append(doc(20 * i + 6 + k, (" ", "\n", "\t ")[k % 3].join(words).upper() if k % 2 else " ".join(words)))
    base = ["h%d" % rng.randrange(9000) for _ in range(120)]
    for i in range(150):  # a large group of near copies
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(120)] = "own%d" % rng.randrange(10**6)
        rows.append(doc(3000 + i, " ".join(words)))
    rows += [doc(4000 + i, rows[0][1]) for i in range(30)]
    rows += [doc(None, rows[3][1]), doc(None, "null id alone words here"), doc(None, "null id alone words here"), doc(4100, None), doc(4101, ""), doc(4102, " \n"), doc(None, None), doc(7, rows[9][1]), doc(7, "another text of id seven"), doc(7, "another text of id seven")]
    return [*rows, doc(5000, " ".join("long%d" % (i % 7001) for i in range(40_000)))]


def test_components_equal_brute_force(spark, frame):
    rows = made(random.Random(3))
    want = brute(rows)
    wide = [(*r, 1, "x", "y") for r in rows]
    docs = frame(wide, DOC + ", _set int, component_id string, _least string")
    for members, cap in ((minhash.MEMBERS, minhash.SHINGLES), (12, 900)):  # the second: every bucket and group in several parts
        got = minhash.near(docs, members=members, shingle_cap=cap).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_exactly_four_in_five_links(frame):
    # 5 and 4 shingles, four of them common; 10 and 8 words apart
    rows = [doc(1, "a b c d e f g h"), doc(2, "a b c d e f g"), doc(3, "a b c d e f"), doc(4, "q w e r t"), doc(5, "Q W\nE\tR T"), doc(6, "x y"), doc(7, "X  y"), doc(8, "x y z")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near(frame(rows)).collect()}
    assert got == {1: (5, 1), 2: (4, 1), 3: (3, 3), 4: (2, 4), 5: (2, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8)}


def test_empty_table_and_texts(frame):
    assert minhash.near(frame([])).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near(frame([doc(2, None), doc(1, ""), doc(None, " ")])).collect()}
    assert got == {2: (0, 2), 1: (0, 1), None: (0, None)}


def test_minima_estimate_the_index():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(100):
        own = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
        a, b = own[:540], own[60:]  # 480 of 600
        x, y = minhash.minima(a), minhash.minima(b)
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.012 and 0.02 < np.std(errors) < 0.05


def test_bucket_connects_what_all_pairs_do():
    rng = random.Random(5)
    kinds = [rng.randbytes(128) for _ in range(6)]
    signs = []
    for i in range(600):
        own = bytearray(kinds[0] if i % 2 else rng.choice(kinds) if i % 5 else rng.randbytes(128))
        for _ in range(rng.randrange(40)):
            own[rng.randrange(128)] = rng.randrange(256)
        signs.append(np.frombuffer(bytes(own), np.uint8))
    asked = 0

    def confirm(a, b):
        nonlocal asked
        asked += 1
        return True

    for big in (8, 64, 10**6):
        bucket, asked = minhash.Bucket(80, confirm, big), 0
        for i, s in enumerate(signs):
            bucket.meet(0, i, (s, None))
        assert asked < 3 * len(signs)
        want = closure(list(range(300)), lambda a, b: (signs[a] == signs[b]).sum() >= 80)
        bucket = minhash.Bucket(80, None, big)
        for i, s in enumerate(signs[:300]):
            bucket.meet(0, i, (s, None))
        assert {(want[i], bucket._root(i)) for i in range(300)} == {(w, bucket._root(w)) for w in set(want.values())} and len({bucket._root(i) for i in range(300)}) == len(set(want.values()))
