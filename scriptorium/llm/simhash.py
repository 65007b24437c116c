"""SimHash near-duplicates with BK-trees.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Distinct fingerprints are sharded: by
the pigeonhole principle, two that differ in `radius` bits at most agree in one of radius + 1 blocks of bits, so each
fingerprint goes to the shard of each of its blocks. A shard's fingerprints form BK-trees of at most some TREE nodes, whose
children are keyed by the Hamming distance to their parent; a search follows only the edges within the radius (linking.py
says how shards of several trees are met in full). Links join into components by rounds of joins, whatever their size.

Near-duplicates by the resemblance of their shingle sets (similar) take trees in two steps: in shards of min-hash bands,
with fingerprints and estimates, to find candidates; then in shards of connected candidates, with the exact Jaccard index.

Defined results: a null text is an empty one; texts without words have fingerprint zero and are near-duplicates of equal
texts only under similar(). Null ids take part; a component's id is the smallest id in it that isn't null. Repeated rows are
returned as often as they stand; remove() keeps one of them, and knows a row by its id and its text together. Texts are equal
if 128 bits of hashes are. An empty table gives an empty result. Whole texts are read,
however long, in memory that grows with one text. Only doc_id and text are read; further columns pass, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, renamed, text_or_empty, with_arrow
from .linking import components
from .linking import links as shard_links

SEED = 42
WORDS = 3
#: Nodes of a BK-tree: some 30 MB of Python objects in a task at most.
TREE = 100_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned. Only A-Z are lower-cased; fewer words than a shingle takes are one shingle."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, last, strict=False)], dtype="<u8")
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        own = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, name: str = "_print", words: int = WORDS) -> DataFrame:
    """docs without the text and with the fingerprint as a signed long."""
    return with_arrow(docs, "text", f"{name} long", lambda texts: [[_signed(fingerprint(t, words)) for t in texts]], drop=True)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks of the 64 bits."""
    borders = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(borders, borders[1:], strict=False)]


def links(prints: DataFrame, radius: int, scratch: Scratch, tree: int = TREE) -> DataFrame:
    """a, b, as signed longs: links that connect what all pairs of the distinct fingerprints (column _print) do that differ in
    radius bits at most."""
    keys = (F.xxhash64(F.lit(i), F.shiftrightunsigned("_print", a).bitwiseAND((1 << n) - 1 if n < 64 else -1)) for i, (a, n) in enumerate(blocks(radius)))
    rows = prints.select(F.explode(F.array(*keys)).alias("_shard"), F.col("_print").alias("_node"), "_print", F.lit(1).alias("_size"), F.lit(None).cast("binary").alias("_payload"))
    return shard_links(rows, radius, tree, scratch, "prints")


def _named(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """_node, _root, component_id of nodes (_node, _least), written: the smallest _least of what edges connect."""
    roots = components(edges, scratch)
    joined = nodes.join(roots, nodes["_node"] == roots["node"], "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root"))
    joined = scratch.keep(joined, "roots")
    ids = scratch.keep(joined.groupBy("_root").agg(F.min("_least").alias("component_id")), "ids")
    return scratch.keep(joined.join(ids, "_root").select("_node", "_root", "component_id"), "named")


def _text_key(text: str = "text") -> dict[str, Column]:
    """128 bits that stand for a text."""
    t = text_or_empty(text)
    return {"_a": F.xxhash64(t), "_b": F.xxhash64(F.lit(1), t)}


def _grouped(docs: DataFrame, radius: int, words: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "simhash")
    own = docs.select("doc_id", *(c.alias(n) for n, c in _text_key().items()), "text")
    rows = scratch.keep(with_fingerprint(own, words=words), "prints")
    nodes = scratch.keep(rows.groupBy("_print").agg(F.min("doc_id").alias("_least")), "nodes")
    named = _named(nodes.withColumnRenamed("_print", "_node"), links(nodes, radius, scratch), scratch)
    return rows.join(named, rows["_print"] == named["_node"]).select("doc_id", "_a", "_b", "_print", "_root", "component_id")


def group(docs: DataFrame, radius: int = 2, words: int = WORDS) -> DataFrame:
    """doc_id, _print (the fingerprint, signed) and component_id of every row."""
    return _grouped(docs, radius, words).select("doc_id", "_print", "component_id")


def remove(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """docs of which found has doc_id, _a, _b (the text's key) and _root (the component): of each component one row stays.

    It is the one of the smallest id, null ones last, then of the smallest key. A row is known by its id and its text
    together, so that rows which share an id, or have none, go or stay each for itself; of rows equal in both one stays.
    """
    whole = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), "_a", "_b")
    counted = scratch.keep(found.groupBy("doc_id", "_a", "_b", "_root").agg(F.count("*").alias("_rows")), "groups")
    stays = counted.groupBy("_root").agg(F.min(whole).alias("_stays"))
    judged = counted.join(stays, "_root").withColumn("_whole", whole)
    key = ["_id", "_none", "_a", "_b"]
    gone = scratch.keep(judged.filter("_whole != _stays").select("_whole.*").select(F.coalesce("_id", F.lit(0)).alias("_id"), *key[1:]), "gone")
    names = docs.columns
    ids, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    rows = renamed(docs).withColumns({"_id": F.coalesce(F.col(ids), F.lit(0)), "_none": F.col(ids).isNull(), **_text_key(text)})
    rows = rows.join(gone.hint("merge"), key, "left_anti")  # dealt at every size, never sent whole
    if counted.filter("_rows > 1").limit(1).count():
        rows = rows.dropDuplicates(key)
    return rows.drop(*key).toDF(*names)


def dedupe(docs: DataFrame, radius: int = 2, words: int = WORDS) -> DataFrame:
    """docs without those near to another in their fingerprints."""
    return remove(docs, _grouped(docs, radius, words), Scratch(docs.sparkSession, "dedupe"))


#: Bands and values in a band of the min-hash keys that shard the trees for wide radii, and values that estimate resemblance.
BANDS, ROWS, VALUES = 20, 5, 128
#: Shingles of a tree's texts: their sets are 64 MB in a task at most.
SHINGLES = 8_000_000
_MULTIPLY = np.random.default_rng(11).integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray | None:
    """Hashes of a text's shingles, as often as they stand; None without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return None
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(joined[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist() or [len(joined)], strict=False)], np.uint64)


def least(hashes: np.ndarray) -> np.ndarray:
    """The least of each permutation of the hashes of a text's shingles."""
    found = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(found, (hashes[at : at + 2048, None] * _MULTIPLY).min(axis=0), out=found)
    return found


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The resemblance of two sets of distinct hashes. A quotient, so that exactly four in five is 0.8."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(found: np.ndarray) -> list[int]:
    """Keys, signed, of the shards of a text: texts of resemblance r share one at least with probability 1 - (1 - r ** ROWS) ** BANDS."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(v.tobytes(), i) - (1 << 63) for i, v in enumerate(found[: BANDS * ROWS].reshape(BANDS, ROWS))]


def short(found: np.ndarray) -> bytes:
    """Eight bits of each value."""
    return ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _matching(resemblance: float):
    """Whether two sets of distinct hashes are as near as that."""

    def match(a: np.ndarray, b: np.ndarray) -> bool:
        few, many = sorted((len(a), len(b)))
        return few >= resemblance * many and jaccard(a, b) >= resemblance

    return match


def similar(docs: DataFrame, **how) -> DataFrame:
    """doc_id and component_id of every row; how as of _similar()."""
    return _similar(docs, **how).select("doc_id", "component_id")


def _similar(docs: DataFrame, resemblance: float = 0.8, words: int = 5, radius: int = 24, tree: int = TREE // 4, shingle_cap: int = SHINGLES) -> DataFrame:
    """doc_id, _a, _b, _root and component_id of every row: texts are linked if the Jaccard index of their shingle sets is `resemblance` or more.

    At a resemblance of 0.8 fingerprints differ in 9.7 bits, with a deviation of 2.9, so the radius is five of these above.
    Candidates are texts that share a min-hash band (a pair at 0.8 shares none with probability 0.0004), that a tree finds
    within the radius and whose VALUES min-hashes estimate a resemblance of no more than five standard errors below the one
    asked for. Candidates that are connected form the second step's shards, where the exact index decides. Equal texts are one.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    needed = VALUES * (resemblance - 5 * (resemblance * (1 - resemblance) / VALUES) ** 0.5)

    def signed(texts: list) -> list:
        out = []
        for t in texts:
            hashes = shingles(t, words)
            if hashes is None:
                out.append((0, [], None, 0))
                continue
            own = np.unique(hashes)
            found = least(own)
            out.append((_signed(_majority(own)), bands(found), short(found), len(own)))
        return list(zip(*out, strict=True)) or [[]] * 4

    def distinct(texts: list) -> list:
        return [[np.unique(shingles(t, words)).astype("<u8").tobytes() for t in texts]]

    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        return int((a == b).sum()) >= needed

    own = docs.select("doc_id", *(c.alias(n) for n, c in _text_key().items()), "text")
    rows = scratch.keep(with_arrow(own, "text", "print long, keys array<bigint>, sign binary, size long", signed, drop=True), "prints")
    nodes = rows.groupBy("_a", "_b").agg(F.min("doc_id").alias("_least"), F.first(F.struct("print", "keys", "sign", "size")).alias("_s"))
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("_node"), "_a", "_b", "_least", "_s.*"), "nodes")
    at = nodes.select("_node", F.explode("keys").alias("_shard"))
    shared = scratch.keep(at.groupBy("_shard").agg(F.count("*").alias("n")).filter("n > 1").select("_shard"), "shared")
    at = at.join(shared, "_shard")
    at = scratch.keep(at.join(nodes.select("_node", "print", "sign"), "_node").select("_shard", "_node", F.col("print").alias("_print"), F.lit(1).alias("_size"), F.col("sign").alias("_payload")), "banded")
    near = shard_links(at, radius, tree, scratch, "near", alike, lambda x: np.frombuffer(x, np.uint8))
    # candidates, by what connects them; of each text the set of one row (more only if its id is repeated or null)
    hit = components(near, scratch, "candidates").join(nodes.select("_node", "_a", "_b", "_least", "print", "size"), F.col("node") == F.col("_node"))
    hit = scratch.keep(hit.select(F.col("root").alias("_shard"), "_node", "_a", "_b", "_least", F.col("print").alias("_print"), F.col("size").alias("_size")), "hit")
    met = own.join(hit.hint("merge"), ["_a", "_b"]).filter(F.col("doc_id").eqNullSafe(F.col("_least")))
    sets = scratch.keep(with_arrow(met.select("_shard", "_node", "_print", "_size", "text"), "text", "_payload binary", distinct, drop=True), "sets")
    edges = shard_links(sets, radius, shingle_cap, scratch, "exact", _matching(resemblance), lambda x: np.frombuffer(x, "<u8"))
    named = _named(nodes.select("_node", "_least"), edges, scratch)
    named = scratch.keep(nodes.select("_node", "_a", "_b").join(named, "_node").drop("_node"), "texts")
    for name in ("shared", "banded", "sets", "hit"):
        scratch.drop(name)
    return rows.select("doc_id", "_a", "_b").join(named, ["_a", "_b"])


def dedupe_similar(docs: DataFrame, **how) -> DataFrame:
    """docs without near-duplicates as similar() finds them."""
    return remove(docs, _similar(docs, **how), Scratch(docs.sparkSession, "dedupe"))
