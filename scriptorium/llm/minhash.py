"""MinHash near-duplicates: universal hash minima in bands, verified by signatures, confirmed on whole shingle sets.

A document's set holds the hashes of its distinct word shingles. Each of VALUES universal hash functions gives the least
value over the set; two sets agree in a minimum with the probability of their Jaccard index. Documents of equal sets are one
node. Nodes that agree in all minima of a band meet in its bucket, where their signatures (a byte of each minimum) decide
whether they are candidates; what candidates connect is a group, in which whole sets confirm each link. A bucket or group
reports what connects its components and not its pairs (Bucket), and is split where it is large (linking.links). Links become
components in rounds of large-star and small-star.

At the Jaccard index asked for, 0.8, a pair shares no bucket with a probability of 5e-8, and its signature falls below the
candidates' bound, five standard errors lower, with one of 2e-6.

Defined results: a null text is an empty one; texts without words have empty sets, linked with nothing, their component is
their own id. A component's id is the smallest in it that isn't null. Repeated rows are returned as often as they stand. An
empty table gives an empty result. Texts are read whole, however long, in memory that grows with one text. Equal ids of
different texts are different nodes. Only doc_id and text are read, whatever further columns are named.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_arrow
from .linking import components, links
from .simhash import shingles

WORDS = 4
VALUES, ROWS = 128, 4
BANDS = VALUES // ROWS
#: Nodes of a bucket, and shingles of a group, that one task holds at once: 3 and 64 MB.
MEMBERS, SHINGLES = 25_000, 8_000_000
_random = np.random.default_rng(13)
#: h(x) = a * x + b modulo 2 ** 64, a odd.
_A = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 64, VALUES, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each function over a set of hashes."""
    found = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(found, (hashes[at : at + 1024, None] * _A + _B).min(axis=0), out=found)
    return found


def buckets(found: np.ndarray) -> list[int]:
    """A signed key for each band."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(v.tobytes(), i) - (1 << 63) for i, v in enumerate(found.reshape(BANDS, ROWS))]


def signature(found: np.ndarray) -> bytes:
    """Eight bits of each minimum."""
    return ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def overlapping(least: int) -> Callable:
    """Whether of two sets of distinct hashes the intersection is `least` hundredths of the union or more."""

    def confirm(a: np.ndarray, b: np.ndarray) -> bool:
        few, many = sorted((len(a), len(b)))
        if 100 * few < least * many:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= least * (len(a) + len(b) - both)

    return confirm


class Bucket:
    """Rows with signatures, and which of them are connected.

    A row is compared with all rows of small components at once, and with those of each large component until one matches:
    its links connect it with every component that has a like of it.
    """

    def __init__(self, needed: float, confirm=None, big: int = 64, chunk: int = 256):
        self.needed, self.confirm, self.big, self.chunk = needed, confirm, big, chunk
        self.signs = np.empty((64, VALUES), np.uint8)
        self.small = np.zeros(64, bool)
        self.names: list[int] = []
        self.sets: list = []
        self.at: dict[int, int] = {}
        self.above: list[int] = []
        self.members: dict[int, list[int]] = {}
        self.large: set[int] = set()

    def _root(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def _alike(self, rows: np.ndarray, sign: np.ndarray) -> np.ndarray:
        return rows[(self.signs[rows] == sign).sum(axis=1) >= self.needed]

    def _matches(self, sign: np.ndarray, own, mine: int | None):
        """Rows that match, one of each component but one's own."""
        met = {mine}
        for root in self.large:
            if root != mine:
                rows = self.members[root]
                for i in range(0, len(rows), self.chunk):
                    found = next((j for j in self._alike(np.array(rows[i : i + self.chunk]), sign) if self.confirm is None or self.confirm(own, self.sets[j])), None)
                    if found is not None:
                        yield int(found)
                        break
        for j in self._alike(np.flatnonzero(self.small[: len(self.names)]), sign):
            if (root := self._root(int(j))) not in met and (self.confirm is None or self.confirm(own, self.sets[j])):
                met.add(root)
                yield int(j)

    def meet(self, value: int, name: int, payload: tuple, add: bool = True) -> list[int]:
        """Names that this row links to; then it is added. A name that is there already isn't added again."""
        sign, own = payload
        mine = self.at.get(name)
        if mine is not None and add:
            return []
        found = list(self._matches(sign, own, None if mine is None else self._root(mine)))
        if add:
            mine = self._added(sign, name, own)
        for j in found:
            if mine is None:  # only searched: what it connects stays apart here
                break
            self._join(mine, j)
        return [self.names[j] for j in found]

    def _added(self, sign: np.ndarray, name: int, own) -> int:
        n = len(self.names)
        if n == len(self.signs):
            self.signs = np.concatenate([self.signs, np.empty_like(self.signs)])
            self.small = np.concatenate([self.small, np.zeros_like(self.small)])
        self.signs[n], self.small[n], self.at[name] = sign, True, n
        self.names.append(name)
        self.sets.append(own)
        self.above.append(n)
        self.members[n] = [n]
        return n

    def _join(self, a: int, b: int) -> None:
        a, b = self._root(a), self._root(b)
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.above[b] = a
        rows = self.members[a]
        was = len(rows)
        rows += self.members.pop(b)
        self.large.discard(b)
        if len(rows) >= self.big:
            self.large.add(a)
            self.small[rows if was < self.big else rows[was:]] = False


def near(docs: DataFrame, least: int = 80, words: int = WORDS, members: int = MEMBERS, shingle_cap: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents are linked if 100 * intersection >= least * union."""
    scratch = Scratch(docs.sparkSession, "minhash")
    share = least / 100
    needed = VALUES * (share - 5 * (share * (1 - share) / VALUES) ** 0.5)

    def made(texts: list) -> list:
        import xxhash

        out = []
        for t in texts:
            hashes = shingles(t, words)
            if hashes is None:
                out.append((0, None, None, None))
                continue
            own = np.unique(hashes)
            found = minima(own)
            out.append((len(own), xxhash.xxh3_128_digest(own.astype("<u8").tobytes()), buckets(found), signature(found)))
        return list(zip(*out, strict=True)) or [[]] * 4

    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"), "text")
    rows = scratch.keep(with_arrow(own, "text", "n_shingles long, _set binary, _keys array<bigint>, _sign binary", made, drop=True), "rows")
    # a node for each set, with its smallest id and the key of a text that has both
    nodes = rows.filter("n_shingles > 0").groupBy("_set").agg(F.min_by(F.struct(F.col("doc_id").alias("_least"), "_a", "_b"), F.struct(F.col("doc_id").isNull(), "doc_id", "_a", "_b")).alias("_n"), F.first(F.struct("_keys", "_sign", F.col("n_shingles").alias("_size"))).alias("_s"))
    nodes = scratch.keep(nodes.select("_set", F.monotonically_increasing_id().alias("_node"), "_n.*", "_s.*"), "nodes")
    at = nodes.select("_node", F.explode("_keys").alias("_shard"))
    shared = scratch.keep(at.groupBy("_shard").agg(F.count("*").alias("n")).filter("n > 1").select("_shard"), "shared")
    at = scratch.keep(at.join(shared, "_shard"), "met")
    none = F.lit(0).cast("long").alias("_print")
    at = at.join(nodes.select("_node", "_sign"), "_node").select("_shard", "_node", none, F.lit(1).alias("_size"), F.col("_sign").alias("_payload"))
    found = links(scratch.keep(at, "banded"), 0, members, scratch, "near", read=lambda x: (np.frombuffer(x, np.uint8), None), make=lambda: Bucket(needed))
    hit = components(found, scratch, "candidates").join(nodes, F.col("node") == F.col("_node"))
    hit = scratch.keep(hit.select(F.col("root").alias("_shard"), "_node", "_least", "_a", "_b", "_size", "_sign"), "hit")
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"), "text")
    texts = texts.join(hit, ["_a", "_b"]).filter(F.col("_id").eqNullSafe(F.col("_least")))

    def whole(texts: list) -> list:
        return [[np.unique(shingles(t, words)).astype("<u8").tobytes() for t in texts]]

    sets = with_arrow(texts.select("_shard", "_node", none, "_size", "_sign", "text"), "text", "_hashes binary", whole, drop=True)
    sets = scratch.keep(sets.select("_shard", "_node", "_print", "_size", F.concat("_sign", "_hashes").alias("_payload")), "sets")
    exact = links(sets, 0, shingle_cap, scratch, "exact", read=lambda x: (np.frombuffer(x, np.uint8, VALUES), np.frombuffer(x, "<u8", -1, VALUES)), make=lambda: Bucket(needed, overlapping(least)))
    roots = components(exact, scratch)
    joined = nodes.join(roots, nodes["_node"] == roots["node"], "left").select("_set", "_least", F.coalesce("root", "_node").alias("_root"))
    joined = scratch.keep(joined, "roots")
    ids = scratch.keep(joined.groupBy("_root").agg(F.min("_least").alias("component_id")), "ids")
    named = scratch.keep(joined.join(ids, "_root").select("_set", "component_id"), "named")
    for name in ("shared", "met", "banded", "sets", "hit"):
        scratch.drop(name)
    rows = rows.select("doc_id", "n_shingles", "_set").join(named, "_set", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
