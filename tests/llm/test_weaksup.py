import re
from collections import Counter

from conftest_llm import doc
from scriptorium.llm import weaksup
from scriptorium.llm.common import WORD, Scratch


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


GOOD = "the quick brown fox and the lazy dog went to the river with a small boat number %d\nand it was late in the day of the %d year"


def test_counts_and_keeping(spark, frame):
    rows = [doc(i, GOOD % (i, i)) for i in range(60)]
    rows += [doc(100 + i, " ".join(f"### {i} $$$ |{j}|" for j in range(30))) for i in range(8)]
    rows += [doc(200, None), doc(201, ""), doc(202, "a b c d e " * 30), doc(203, "x\n\n \nx\n x\r\nx"), doc(204, "é\xa0ü ß\x0b🙂" * 4), doc(1, rows[1][1])]
    got = weaksup.score(frame(rows), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), r
        if r.doc_id < 60:
            assert r.kept
        elif r.doc_id < 203:
            assert not r.kept, r
    kept = weaksup.apply(frame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_words long, _kept int"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_words", "_kept"]
    assert weaksup.apply(frame([])).count() == 0


def test_estimate_recovers_accuracies():
    import numpy as np

    rng = np.random.default_rng(5)
    truth = rng.random(40000) < 0.7
    on_good = np.linspace(0.9, 0.98, len(weaksup.RULES))
    on_bad = np.linspace(0.5, 0.8, len(weaksup.RULES))
    right = [rng.random(40000) < np.where(truth, g, b) for g, b in zip(on_good, on_bad)]
    votes = [np.where(rng.random(40000) < 0.3, 0, np.where(r == truth, 1, -1)) for r in right]
    found, share = weaksup.estimate(Counter(zip(*(v.tolist() for v in votes))))
    assert np.abs(found - np.stack([on_good, on_bad], axis=1)).max() < 0.04 and abs(share - 0.7) < 0.03
    assert weaksup.estimate({})[1] == 0.5
