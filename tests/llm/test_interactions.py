import itertools
import random
import re
from fractions import Fraction

from scriptorium.llm import interactions

DOC = "doc_id long, text string, source string"
LABEL = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = ""
    found += "A" * (len(words) < 200)
    found += "B" * (100 * len(set(words)) < 50 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    found += "D" * bool(re.search(r"[#$%&*|]", text))
    return found


def walked(docs, labels):
    """Every order walked document by document."""
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    own = [(p or "", fails(t or "") + "E" * (i is not None and i > texts[t or ""]), any(x[0] == i is not None and x[1] == 1 for x in labels), any(x[0] == i is not None and x[2] == 1 for x in labels)) for i, t, p in docs]
    out = {}
    for part in {p for p, *_ in own}:
        for order in itertools.permutations("ABCDE"):
            left = [x[1:] for x in own if x[0] == part]
            every = left
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                out[part, "".join(order), step] = (len(left), len(gone), sum(letter in x[0] for x in every) - len(gone), sum(x[0] == letter for x in every), sum(x[1] for x in gone), sum(x[2] for x in gone))
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row, total[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def made(rng):
    pool = ["word%d" % i for i in range(400)]
    docs = []
    for i in range(60):
        words = [rng.choice(pool[: rng.choice((20, 400))]) for _ in range(rng.choice((3, 150, 199, 200, 260)))]
        text = " ".join(words)
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += " %"
        docs.append((i, text, rng.choice(("a", "b", None, ""))))
    docs += [(100, docs[3][1], "a"), (101, docs[3][1], "b"), (3, docs[3][1], "a"), (3, docs[3][1], "a"), (None, docs[3][1], "a"), (None, None, None), (102, None, "c"), (103, "", "c"), (104, "  \n", "c"), (104, "x" * 300_000, "c")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 110, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (3, 1, 1)]
    return docs, [(a, b, None if c is None else int(c)) for a, b, c in labels]


def test_audit_equals_walking_every_order(spark):
    docs, labels = made(random.Random(1))
    wide = [(*d, 7, "x", "y") for d in docs]
    got = interactions.audit(spark.createDataFrame(wide, DOC + ", mask int, part string, n string"), spark.createDataFrame([(*x, "z") for x in labels], LABEL + ", text string"))
    assert got.dtypes == [tuple(f.replace("long", "bigint").split()) for f in interactions.RESULT.split(", ")]
    rows = got.collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in rows} == walked(docs, labels) and len(rows) == 4 * 600


def test_empty_tables(spark):
    docs, labels = made(random.Random(2))
    none = spark.createDataFrame([], DOC)
    assert interactions.audit(none, spark.createDataFrame(labels, LABEL)).count() == 0
    rows = interactions.audit(spark.createDataFrame(docs, DOC), spark.createDataFrame([], LABEL)).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in rows} == walked(docs, [])


def test_polynomial():
    rng = random.Random(3)
    counts = {m: rng.randrange(9) for m in range(8)}
    poly = interactions.polynomial(counts, 3)
    for s in range(8):
        assert interactions.corner(poly, s) == sum(n for m, n in counts.items() if m & s)
    # by its definition: the mean marginal removal over all orders
    for i in range(3):
        mean = Fraction(0)
        for order in itertools.permutations(range(3)):
            before = sum(1 << j for j in order[: order.index(i)])
            mean += Fraction(sum(n for m, n in counts.items() if m >> i & 1 and not m & before), 6)
        assert interactions.shapley(poly, i) == mean
        # the derivative at a corner is what the filter adds there
        for s in (s for s in range(8) if not s >> i & 1):
            assert sum(a for t, a in interactions.derivative(poly, i).items() if t & s == t) == interactions.corner(poly, s | 1 << i) - interactions.corner(poly, s)


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "p"), (2, "b", "p"), (3, "b", "p")], DOC)
    rows = interactions.audit(docs, spark.createDataFrame([], LABEL), filters={"X": lambda text, coded, words: text == "b"}).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows) == [("EX", 1, 2, 1, 0, 0, 1), ("EX", 2, 1, 1, 1, 1, 3), ("XE", 1, 1, 2, 0, 1, 3), ("XE", 2, 1, 0, 1, 0, 1)]
