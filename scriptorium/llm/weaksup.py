"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Documents are counted by their pattern of votes (at most
3 to the number of rules), and expectation-maximisation over those counts estimates each rule's accuracy on good and on bad
documents where it votes, and the share of good documents. A document's posterior probability of being good follows from
its votes and these accuracies; a rule that abstains says nothing.

Defined results: a null text is an empty one; it has no words and fails the base rule. Rules without votes have accuracies
of one half. An empty table gives an empty result. Repeated rows are judged alike. apply() keeps every column of its input,
whatever their names. A verdict depends on the whole text alone, read in memory that grows with one text.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, renamed, text_or_empty, with_arrow

SYMBOLS = "#*$%&|<>"
#: The most frequent function words of the corpus languages. Fixed values.
STOP_WORDS = {
    "en": "the be to of and that have with is in it for on as was are this by from at an or",
    "fr": "le la les de des du et un une est que qui dans pour pas au aux sur avec elle",
    "de": "der die das und zu den dem ein eine ist sich mit von auf nicht als es im für",
    "es": "el la los las de del y que en un una se no por con su al es lo para",
}
RULES = ("length", "symbols", "repeated_lines", "repeated_words", "word_length", "stop_words", "letters", "upper_case", "bare_symbols", "doubled_words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ", ".join([*(f"{n}: long" for n in BASE), *(f"v_{r}: int" for r in RULES)])
#: First guess of the probability of being good, by the number of bad votes: none, one, more.
FIRST = (0.98, 0.35, 0.1)

_bare = frozenset(c.encode() for c in "|#*$%&<>-=_+~/\\.:;,!?")
_stops = frozenset(w.encode() for x in STOP_WORDS.values() for w in x.split())


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words in windows of n that stand twice or more in the text, the first ones included."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + n - max(end, i)
            end = i + n
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The base counts of a text and the votes of the rules on it."""
    text = text or ""
    coded = text.encode("utf-8", "surrogatepass")
    words = coded.split()
    n = len(words)
    chars = len(text) - sum(map(coded.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(text.count, SYMBOLS))
    seen, lines, doubled = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += 1
            doubled += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    if not n:
        return (0, chars, symbols, doubled, 0, -1, *[0] * (len(RULES) - 1))
    bare = sum(w in _bare for w in words)
    twice = sum(map(eq, words, words[1:]))
    mean = chars / n
    stops = sum(map(_stops.__contains__, coded.lower().split()))
    plain = len(coded.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz \t\n\v\f\r"))
    letters = 1 - len(coded.translate(None, bytes(range(0x80, 0x100)) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz \t\n\v\f\r")) / max(1, len(coded)) if plain else 1.0
    upper, lower = (len(coded) - len(coded.translate(None, s)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

    def vote(good: bool, bad: bool) -> int:
        return 1 if good else -1 if bad else 0

    return (
        n,
        chars,
        symbols,
        doubled,
        repeated,
        vote(n >= 20, n < 10),
        vote(symbols * 50 <= n, symbols * 10 > n),
        vote(doubled * 20 <= lines, doubled * 10 > 3 * lines and doubled >= 3),
        vote(repeated * 20 <= n, repeated * 5 > n),
        vote(3 <= mean <= 10, mean < 2 or mean > 14),
        vote(stops * 25 >= n, stops * 100 < n and n >= 20),
        vote(letters >= 0.85, letters < 0.7 and n >= 20),
        vote(upper * 5 <= upper + lower, upper * 2 > upper + lower and n >= 5),
        vote(bare * 50 <= n, bare * 10 > n),
        vote(twice * 50 <= n, twice * 10 > n),
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs without the text, and with a struct of the base counts and votes, _measures."""
    names = [*BASE, *(f"v_{r}" for r in RULES)]

    def judge(texts: list) -> list:
        return [[dict(zip(names, measure(t), strict=True)) for t in texts]]

    return with_arrow(docs, "text", f"_measures struct<{MEASURES}>", judge, drop=True)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 300) -> tuple[np.ndarray, float]:
    """For each rule how often it is right on good and on bad documents where it votes, and the share of good documents."""
    accuracy, share = np.full((len(RULES), 2), 0.5), 0.5
    if not patterns:
        return accuracy, share
    votes, counts = np.array(list(patterns)), np.array(list(patterns.values()), float)
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    good = np.choose(np.minimum(down.sum(axis=1), 2).astype(int), FIRST)
    for _ in range(rounds):
        share = float(np.clip(counts @ good / counts.sum(), 0.02, 0.98))
        rates = []
        for own, right, wrong in ((good, up, down), (1 - good, down, up)):
            a, b = (counts * own) @ right, (counts * own) @ wrong
            rates.append((a + 0.5) / (a + b + 1))
        accuracy = np.array(rates).T
        odds = math.log(share / (1 - share)) + up @ weight(accuracy)[:, 0] + down @ weight(accuracy)[:, 1]
        new = 1 / (1 + np.exp(-odds))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return accuracy, share


def weight(accuracy: np.ndarray) -> np.ndarray:
    """What a good and a bad vote of each rule add to the log odds. A bad vote never speaks for a document, nor a good one against it."""
    on_good, on_bad = accuracy[:, 0], accuracy[:, 1]
    return np.stack([np.maximum(0, np.log(on_good / (1 - on_bad))), np.minimum(0, np.log((1 - on_good) / on_bad))], axis=1)


def posterior(accuracy: np.ndarray, share: float, votes: str = "_measures") -> Column:
    logit = F.lit(math.log(share / (1 - share)))
    for rule, (up, down) in zip(RULES, weight(accuracy).tolist(), strict=True):
        vote = F.col(f"{votes}.v_{rule}")
        logit = logit + F.when(vote > 0, up).when(vote < 0, down).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def base_failed(at: str = "_measures") -> Column:
    return (F.col(f"{at}.n_words") < 10) | (100 * F.col(f"{at}.n_repeat_words") > 20 * F.col(f"{at}.n_words"))


def fit(rows: DataFrame, at: str = "_measures") -> tuple[np.ndarray, float]:
    """From measured rows: one row for each pattern of votes goes to the driver."""
    names = [f"v_{r}" for r in RULES]
    found = rows.groupBy(*(F.col(f"{at}.{n}").alias(n) for n in names)).count().collect()
    return estimate({tuple(r[n] for n in names): r["count"] for r in sorted(found)})


def apply(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns: the base rule passed and a posterior of `least` or more.

    Each text is measured once; what is rejected is known by two hashes of its text, and goes by a join with these.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    names = docs.columns
    text = f"c{names.index('text')}"
    rows = renamed(docs).withColumns({"_a": F.xxhash64(text_or_empty(text)), "_b": F.xxhash64(F.lit(1), text_or_empty(text))})
    found = scratch.keep(measured(rows.select("_a", "_b", F.col(text).alias("text"))), "measures")
    accuracy, share = fit(found)
    bad = scratch.keep(found.filter(base_failed() | (posterior(accuracy, share) < least)).select("_a", "_b").distinct(), "bad")
    return rows.join(bad.hint("merge"), ["_a", "_b"], "left_anti").drop("_a", "_b").toDF(*names)


def score(docs: DataFrame, scratch, least: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, the posterior and kept, of every document."""
    rows = scratch.keep(measured(docs.select("doc_id", "text")), "measures")
    accuracy, share = fit(rows)
    good = posterior(accuracy, share)
    return rows.select("doc_id", *(F.col(f"_measures.{n}").alias(n) for n in BASE), base_failed().alias("base_failed"), good.alias("posterior"), (~base_failed() & (good >= least)).alias("kept"))
