"""Filter interaction audit: what each filter removes in each order, and its Shapley value over all orders.

A document has a mask, with a bit for each filter that it fails. Documents are counted by part and mask, at most 2 to the
number of filters for each part, and everything follows from these counts. How many documents a set of filters removes
extends to a multilinear polynomial over the filters' inclusion in [0, 1]: a document that fails the set m adds
1 - prod(1 - x_i for i in m), whose coefficients are counts of documents. At a corner of the cube the polynomial gives what
that set removes, hence survivors of each step of each order; a filter's Shapley value is the integral of its partial
derivative along the diagonal, exact in rationals.

Defined results: a null text is an empty one, a null part the part ''. A document is a copy if an equal text has a smaller
id: the id decides alone, so rows of one id are no copies of each other, and a row without an id is none and makes none.
Labels of one document count once, as good or toxic if one of them says so; labels without an id say nothing. Repeated rows
are counted as often as they stand. An empty table has no parts and gives no rows. Texts are read whole, in memory that
grows with one text. Only doc_id, text, the part's column, and doc_id, quality, toxic of the labels are read, whatever
further columns are named. Texts are equal if 128 bits of a cryptographic hash are.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import cache
from hashlib import blake2b
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_arrow

_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Whether a text (its characters, bytes and words) fails, by the filter's letter.
FILTERS: dict[str, Callable[[str, bytes, list[bytes]], bool]] = {
    "A": lambda text, coded, words: len(words) < 200,
    "B": lambda text, coded, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, coded, words: 100 * (len(coded) - len(coded.translate(None, _CAPITALS))) > 2 * len(text),
    "D": lambda text, coded, words: len(coded.translate(None, _SYMBOLS)) < len(coded),
}
#: The filter that removes copies of earlier documents; it needs the whole table.
COPIES = "E"


def mask_of(text: str | None, filters: dict[str, Callable] = FILTERS) -> int:
    text = text or ""
    coded = text.encode("utf-8", "surrogatepass")
    words = coded.split()
    return sum(1 << i for i, fails in enumerate(filters.values()) if fails(text, coded, words))


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail, the copies' filter last."""
    scratch = Scratch(docs.sparkSession, "interactions")

    def judged(texts: list) -> list:
        return [[mask_of(t, filters) for t in texts], [blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]]

    own = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    rows = scratch.keep(with_arrow(own, "text", "_mask int, _text binary", judged, drop=True), "judged")
    # of each text the smallest id: joined by text and id, so that a frequent text is no task's join
    first = rows.filter("_id is not null").groupBy("_text").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    units = rows.groupBy("_id", "_text", "part", "_mask").agg(F.count("*").alias("_n"))
    copy = F.col("_id").isNotNull() & F.col("_first").isNull()
    units = units.join(first, ["_id", "_text"], "left").withColumn("mask", F.col("_mask") + F.when(copy, 1 << len(filters)).otherwise(0))
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(says("quality"), says("toxic"))
    rows = units.join(known, "_id", "left")
    count = lambda c: F.sum(F.when(F.col(c) == 1, F.col("_n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.sum("_n").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def polynomial(counts: dict[int, int], k: int) -> list[int]:
    """The coefficients, by set of variables, of the multilinear polynomial of how many documents go.

    1 - prod(1 - x_i for i in m) has the coefficient (-1) ** (|t| + 1) for each set t within m but the empty one.
    """
    over = [counts.get(m, 0) for m in range(1 << k)]  # becomes, by set, the documents that fail all of it
    for bit in range(k):
        for m in range(1 << k):
            if not m >> bit & 1:
                over[m] += over[m | 1 << bit]
    return [0, *((1 if t.bit_count() % 2 else -1) * over[t] for t in range(1, 1 << k))]


def corner(poly: list[int], filters: int) -> int:
    """The polynomial where the variables of a set of filters are one and the others are zero: what this set removes."""
    total, t = 0, filters
    while t:
        total += poly[t]
        t = (t - 1) & filters
    return total


def derivative(poly: list[int], i: int) -> dict[int, int]:
    """The coefficients of the partial derivative by one variable."""
    return {t ^ 1 << i: a for t, a in enumerate(poly) if t >> i & 1}


def shapley(poly: list[int], i: int) -> Fraction:
    """The mean of what a filter removes over all orders: the integral of the partial derivative along the diagonal."""
    return sum((Fraction(a, t.bit_count() + 1) for t, a in derivative(poly, i).items()), Fraction(0))


@cache
def _orders(letters: str) -> list[tuple[str, int, int, int]]:
    """Order, step, place of the step's filter, and the set of filters before it."""
    steps = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(letters[j] for j in order), step, i, before))
            before |= 1 << i
    return steps


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps(counts: dict[int, tuple[int, int, int]], letters: str) -> list[tuple]:
    """The result's rows of one part, without its name; counts: documents, good and toxic ones by mask."""
    k, whole = len(letters), (1 << len(letters)) - 1
    polys = [polynomial({m: c[j] for m, c in counts.items()}, k) for j in range(3)]
    total = sum(c[0] for c in counts.values())
    gone = [[corner(p, s) for s in range(1 << k)] for p in polys]
    unique = [gone[0][whole] - gone[0][whole ^ 1 << i] for i in range(k)]
    scaled = [int(factorial(k) * shapley(polys[0], i)) for i in range(k)]
    out = []
    for order, step, i, before in _orders(letters):
        after = before | 1 << i
        removed, good, toxic = (g[after] - g[before] for g in gone)
        out.append((order, step, total - gone[0][after], removed, gone[0][1 << i] - removed, unique[i], good, toxic, scaled[i]))
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """RESULT: for each part, order of the filters and step what the step keeps and removes."""
    letters = "".join(filters) + COPIES
    each = masks(docs, labels, part, filters).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_counts"))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for name, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = steps({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts}, letters)
                order, step, *numbers = zip(*found, strict=True)
                columns = [pa.array([name] * len(found)), pa.array(order), pa.array(step, pa.int32()), *(pa.array(x, pa.int64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])

    return each.mapInArrow(rows, RESULT)
