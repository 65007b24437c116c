"""Language-model scores from a sharded Elias-Fano trie of word bigrams.

Level 1 holds the words: their sorted 64-bit hashes in Elias-Fano code and their exact counts. Level 2 holds, for each
context word, the words that follow it: contexts, pointers to where their followers start, and the followers are monotone
and in Elias-Fano code. A follower stands as its number above the last entry of the context before, so that the level rises;
a pair is found by reading its context's two pointers and a successor search between them, relative to that entry. Next to
the followers stand the smoothed log10 probabilities, quantised to 256 values. Both levels are files in the folder that
executors share; they map them into memory, and no executor holds a level on its heap.

Smoothing: P(w | v) = (c(v w) + k P(w)) / (c(v) + k) with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); k is the one of GRID under
which all training pairs, each left out in turn, are likeliest. Every document starts after, and ends with, the end token.

Scale: words are sharded by hash, pairs by context; a context with over a shard's share of all tokens is split by follower, so
that none is too large for a task. Pairs are counted within blocks of text before they are shuffled, as numbers. Counts
cover all training documents; nothing is pruned.

Defined results: a null or empty text is the end token alone; a null id counts as the empty string (held out). Without
training documents every score is that of the unigram formula. Repeated rows count and are scored each. A text of any length
is counted and scored whole, in memory that grows with one text. Only doc_id and text
are read. A shard's file that is lost fails the job. spark.checkpoint.dir must be a path that executors can open and map (a shared mount).
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .eliasfano import EliasFano, load, save

ADD = 0.1
GRID = tuple(2.0**i for i in range(-2, 23, 2))
#: Words in a shard of level 1 and tokens in a shard of level 2, about.
WORDS_A_SHARD, TOKENS_A_SHARD = 1 << 20, 1_500_000
#: Tokens that a task counts or scores at once.
BLOCK = 600_000
END = b""
NONE = np.int64(-1)


def training(doc_id: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds != 0


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _digest(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _shared(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: the trie's files must be in a folder that executors can open; set spark.checkpoint.dir to a shared mount")
    return parsed.path


class Blocks:
    """Texts as numbers: of each block the distinct words, each token's place among them, and each text's number of tokens."""

    def __init__(self, texts: Iterator) -> None:
        self.texts = texts

    def __iter__(self):
        place, ids, sizes = self._new(), [], []
        for text in self.texts:
            own = tokens(text)
            ids += map(place.__getitem__, own)
            sizes.append(len(own))
            if len(ids) >= BLOCK:
                yield list(place), np.array(ids, np.int64), np.array(sizes, np.int64)
                place, ids, sizes = self._new(), [], []
        if sizes:
            yield list(place), np.array(ids, np.int64), np.array(sizes, np.int64)

    @staticmethod
    def _new() -> defaultdict[bytes, int]:
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        return place


def _before(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Of each token the one before it in its text, at the start the end token."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(sizes) - sizes] = end
    return out


class Model:
    """The levels, opened where they are used. Holds paths and a few numbers; what it maps isn't pickled."""

    def __init__(self, path: str, total: int, sizes: list[int], hot: list[tuple[int, int]], shards: int, k: float = 0.0):
        self.path, self.total, self.sizes, self.hot, self.shards, self.k = path, total, sizes, hot, shards, k
        self.vocabulary = sum(sizes)

    def __getstate__(self):
        return {n: v for n, v in self.__dict__.items() if not n.startswith("_")}

    def _open(self) -> None:
        if hasattr(self, "_starts"):
            return
        self._shift = 64 - (len(self.sizes).bit_length() - 1)
        self._starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self._words: dict[int, tuple[EliasFano, np.ndarray]] = {}
        self._pairs: dict[int, dict | None] = {}
        found = self.numbers(np.array([h for h, _ in self.hot], np.uint64))
        order = np.argsort(found)
        self._hot = found[order]
        parts = np.array([n for _, n in self.hot], np.int64)
        first = self.shards + np.cumsum(parts) - parts
        self._hot_parts, self._hot_first = parts[order], first[order]

    def _level1(self, shard: int) -> tuple[EliasFano, np.ndarray]:
        if shard not in self._words:
            arrays = load(f"{self.path}/words-{shard}")
            self._words[shard] = EliasFano.of(arrays, "hash"), arrays["count"]
        return self._words[shard]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for unknown words."""
        self._open_starts()
        out = np.full(len(hashes), NONE)
        if not self.vocabulary:
            return out
        shard = (hashes >> np.uint64(self._shift)).astype(np.int64) if self._shift < 64 else np.zeros(len(hashes), np.int64)
        rest = hashes & np.uint64((1 << self._shift) - 1)
        for s in np.unique(shard).tolist():
            if self.sizes[s]:
                own = np.flatnonzero(shard == s)
                at = self._level1(s)[0].find(rest[own])
                out[own] = np.where(at >= 0, at + self._starts[s], NONE)
        return out

    def _open_starts(self) -> None:
        if not hasattr(self, "_starts"):
            self._open()

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Exact counts; 0 for -1."""
        self._open_starts()
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self._starts, numbers, side="right") - 1
        for s in np.unique(shard[numbers >= 0]).tolist():
            own = np.flatnonzero(shard == s)
            out[own] = self._level1(s)[1][numbers[own] - self._starts[s]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts."""
        return (counts + ADD) / (self.total + ADD * (self.vocabulary + 1))

    def shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self._open_starts()
        out = a * self.shards // max(1, self.vocabulary)
        if len(self._hot):
            at = np.minimum(np.searchsorted(self._hot, a), len(self._hot) - 1)
            hot = self._hot[at] == a
            mixed = (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out = np.where(hot, self._hot_first[at] + (mixed % self._hot_parts[at].astype(np.uint64)).astype(np.int64), out)
        return out

    def build(self, shard: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Writes the shard of these pairs, sorted."""
        contexts, first = np.unique(a, return_index=True)
        last = np.append(first[1:], len(a)) - 1
        above = np.cumsum(b[last] + 1)  # after each context's followers, the next one's start
        base = np.repeat(np.concatenate([[0], above[:-1]]), np.diff([*first, len(a)]))
        logs = np.log10(self.smoothed(a, b, c))
        edges = np.quantile(logs, np.linspace(0, 1, 257)) if len(logs) else np.zeros(257)
        code = np.clip(np.searchsorted(edges, logs, side="right") - 1, 0, 255)
        sums, n = np.bincount(code, logs, 256), np.bincount(code, minlength=256)
        book = np.where(n > 0, sums / np.maximum(n, 1), edges[:256])
        save(
            f"{self.path}/pairs-{shard}",
            EliasFano.build(contexts).arrays("context")
            | EliasFano.build(np.append(first, len(a))).arrays("pointer")
            | EliasFano.build((base + b).astype(np.uint64)).arrays("follower")
            | {"code": code.astype(np.uint8), "book": book.astype(np.float64)},
        )

    def smoothed(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (c + self.k * self.base(self.counts(b))) / (self.counts(a) + self.k)

    def _level2(self, shard: int) -> dict | None:
        """None if there are no pairs in the shard; the list of shards says so, and not that a file is missing."""
        if shard not in self._pairs:
            if not hasattr(self, "_written"):
                self._written = load(f"{self.path}/pairs")["shard"]
            at = np.searchsorted(self._written, shard)
            there = at < len(self._written) and self._written[at] == shard
            arrays = load(f"{self.path}/pairs-{shard}") if there else None
            self._pairs[shard] = arrays and {n: EliasFano.of(arrays, n) for n in ("context", "pointer", "follower")} | {"code": arrays["code"], "book": arrays["book"]}
        return self._pairs[shard]

    @staticmethod
    def _followers(level: dict, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the followers of the contexts at these places start and end, and what their numbers stand above."""
        first, end = level["pointer"].get(place).astype(np.int64), level["pointer"].get(place + 1).astype(np.int64)
        base = np.zeros(len(place), np.uint64)
        later = np.flatnonzero(first > 0)
        base[later] = level["follower"].get(first[later] - 1) + np.uint64(1)
        return first, end, base

    def logs(self, a: np.ndarray, b: np.ndarray, number: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(b | a) of pairs of words, sorted by a, as places in number and counts; number -1 is an unknown word."""
        rest = self.base(counts)
        own = counts[a]
        out = np.log10(np.where(own > 0, self.k * rest[b] / (own + self.k), rest[b]))
        known = np.flatnonzero((number[a] >= 0) & (number[b] >= 0))
        a, b = number[a[known]], number[b[known]]
        shard = self.shard(a, b)
        order = np.argsort(shard, kind="stable")
        known, shard, a, b = known[order], shard[order], a[order], b[order]
        borders = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else []
        for lo, hi in zip(borders, borders[1:], strict=False):
            level = self._level2(int(shard[lo]))
            if level is None:
                continue
            first = np.flatnonzero(np.diff(a[lo:hi], prepend=-1))  # each context is sought once
            place = level["context"].find(a[lo:hi][first].astype(np.uint64))
            there = np.flatnonzero(place >= 0)
            ranges = np.zeros((3, len(first)), np.int64)
            ranges[:, there] = self._followers(level, place[there])
            times = np.diff([*first, hi - lo])
            some = np.flatnonzero(np.repeat(place >= 0, times))
            start, end, base = (np.repeat(x, times)[some] for x in ranges)
            at = level["follower"].find((base + b[lo:hi][some]).astype(np.uint64), start, end)
            met = at >= 0
            out[known[lo:hi][some[met]]] = level["book"][level["code"][at[met]]]
        return out


def _word_counts(docs: DataFrame) -> DataFrame:
    def rows(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(_digest(list(counts)).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["h", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > 1_000_000:
                    yield out()
                    counts = Counter()
        yield out()

    return docs.select("text").mapInArrow(rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _by_shard(batches, columns: int):
    """(shard, rows) of batches sorted by shard, the first column."""
    last, group = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if row[0] != last and group:
                yield last, group
                group = []
            last = row[0]
            group.append(row)
    if group:
        yield last, group


def _level1(words: DataFrame, path: str, bits: int, n: int) -> list[int]:
    def write(batches):
        import pyarrow as pa

        done, last, held = [], None, []

        def flush():
            h = np.concatenate([x[0] for x in held]).view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
            c = np.concatenate([x[1] for x in held])
            order = np.argsort(h)
            save(f"{path}/words-{last}", EliasFano.build(h[order]).arrays("hash") | {"count": c[order].astype(np.uint32 if c.max() < 1 << 32 else np.int64)})
            done.append((last, len(h)))

        for batch in batches:
            shard, h, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            borders = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(shard)]
            for a, b in zip(borders, borders[1:], strict=False):
                if shard[a] != last:
                    if held:
                        flush()
                    last, held = int(shard[a]), []
                held.append((h[a:b], c[a:b]))
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.int64())], names=["shard", "n"])

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    rows = words.select(shard.alias("shard"), "h", "c").repartition(n, "shard").sortWithinPartitions("shard")
    found = {r.shard: r.n for r in rows.mapInArrow(write, "shard int, n long").collect()}  # a number for each shard
    return [found.get(s, 0) for s in range(1 << bits)]


def _counted(a: np.ndarray, b: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and the sums of their counts (of ones if there are none)."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    if int(a.max()) >> 32 or int(b.max()) >> 32:  # numbers of a vocabulary of 2 ** 32 words or more
        order = np.lexsort((b, a))
    else:
        order = np.argsort(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), kind="stable")
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    sums = np.diff(np.append(first, len(a))) if counts is None else np.add.reduceat(counts[order], first)
    return a[first], b[first], sums.astype(np.int64)


def _joined(rows, kind=np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of packed rows (shard, firsts, seconds, counts)."""
    return _counted(*(np.concatenate([np.frombuffer(r[i], kind) for r in rows]).astype(np.int64) for i in (1, 2, 3)))


def _pairs(docs: DataFrame, model: Model, n: int) -> DataFrame:
    """shard, a, b, counts (packed) and the left-out log likelihoods of GRID, of each shard."""
    kind = np.dtype(np.uint32 if model.vocabulary < 1 << 32 else np.int64)  # of numbers, and of counts within a block

    def blocks(batches):
        import pyarrow as pa

        texts = (t.as_py() for batch in batches for t in batch.column(0))
        for words, ids, sizes in Blocks(texts):
            number = model.numbers(_digest(words))[ids]
            end = model.numbers(_digest([END]))[0]
            a, b, counts = _counted(_before(number, sizes, end), number)
            shard = model.shard(a, b)
            order = np.argsort(shard, kind="stable")
            packed = [x[order].astype(kind) for x in (a, b, counts)]
            shard = shard[order]
            borders = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(shard)]
            spans = list(zip(borders, borders[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[i]) for i, _ in spans], pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in packed)], names=["shard", "a", "b", "counts"])

    def join(batches):
        import pyarrow as pa

        for shard, rows in _by_shard(batches, 4):
            a, b, counts = _joined(rows, kind)
            own, rest = model.counts(a), model.base(model.counts(b))
            left = [float(counts @ np.log((counts - 1 + k * rest) / (own - 1 + k))) for k in GRID]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (a, b, counts)), pa.array([left], pa.list_(pa.float64()))], names=["shard", "a", "b", "counts", "left"])

    rows = docs.select("text").mapInArrow(blocks, "shard int, a binary, b binary, counts binary")
    return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(join, "shard int, a binary, b binary, counts binary, left array<double>")


def train(docs: DataFrame, scratch: Scratch) -> Model:
    """The model of all texts of docs."""
    words = scratch.keep(_word_counts(docs), "words")
    total, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    path = _shared(f"{scratch.path}/trie")
    os.makedirs(path, exist_ok=True)
    if not total:
        return Model(path, 0, [0], [], 1)
    bits = max(0, (vocabulary // WORDS_A_SHARD).bit_length())
    parts = partitions(docs.sparkSession)
    sizes = _level1(words, path, bits, max(parts, 1 << bits))
    shards = math.ceil(total / TOKENS_A_SHARD)
    hot = words.filter(F.col("c") * shards >= total).collect()  # at most so many as there are shards
    model = Model(path, total, sizes, [(r.h & (1 << 64) - 1, math.ceil(r.c * shards / total) + 1) for r in sorted(hot)], shards)
    pairs = scratch.keep(_pairs(docs, model, max(parts, shards)), "pairs")
    left = pairs.agg(*(F.sum(F.col("left")[i]) for i in range(len(GRID)))).first()
    model.k = max(zip(left, GRID, strict=True))[1]

    def write(batches):
        import pyarrow as pa

        for shard, rows in _by_shard(batches, 4):
            model.build(shard, *_joined(rows))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    written = pairs.select("shard", "a", "b", "counts").mapInArrow(write, "shard int").collect()  # a number for each shard
    save(f"{path}/pairs", {"shard": np.array(sorted(r.shard for r in written), np.int64)})
    scratch.drop("pairs")
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for words, ids, sizes in Blocks(t.as_py() for t in batch.column(1)):
                number = model.numbers(_digest(words))
                counts = model.counts(number)
                before = _before(ids, sizes, words.index(END))
                pairs, inverse = np.unique(before * len(words) + ids, return_inverse=True)
                logs = model.logs(*np.divmod(pairs, len(words)), number, counts)[inverse]
                starts = np.cumsum(sizes) - sizes
                sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                out = (batch.column(0).slice(at, len(sizes)), pa.array(sizes), pa.array(sums((counts > 0)[ids].astype(np.int64))), pa.array(sums(np.log10(model.base(counts))[ids])), pa.array(sums(logs)))
                yield pa.RecordBatch.from_arrays(list(out), names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
                at += len(sizes)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def fit_and_score(docs: DataFrame) -> DataFrame:
    """score() of all documents by a model of the training ones, with held_out and train_tokens."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    model = train(docs.filter(training()), scratch)
    return score(docs, model).withColumns({"held_out": ~training(), "train_tokens": F.lit(model.total).cast("long")})


def crc_fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10
