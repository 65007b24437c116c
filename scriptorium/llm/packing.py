"""Packing documents into sequences: linear grouping, configurations, substitution, best fit.

Documents are tokenised and cut into pieces. How many pieces have each length (at most `capacity` numbers) is all that the
plan needs, so it is made on the driver from counts, whatever the size of the corpus: large lengths are rounded up within
groups of equal cardinality, the few-size problem is optimised over configurations (column generation), actual lengths
replace the rounded ones, and best fit fills what is left with the small pieces. Pieces of one length are interchangeable:
each takes its rank in the order (length, hash), found by distributed prefix sums, and its rank tells its sequence and offset.

Defined results: a null or empty text is a piece of the end id alone; repeated rows are packed as often as they stand; an
empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered, running

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of the token cache of a Python worker (some 100 MB at most).
CACHE = 400_000
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
_ODD = re.compile("[\x1c-\x1f]|<\\|endoftext\\|>")


class Encoder(dict):
    """Ids of byte-level BPE as little-endian unsigned 32-bit bytes.

    The splitting pattern never joins text across the chunks of _CHUNK (a run of non-space with one space before it, or
    white space), so chunks are encoded once and then looked up. Texts with a special token's string, or with the control
    characters that Python alone counts as white space, go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        found = np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) < 64:
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or full ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenise(docs: DataFrame, path: str, capacity: int, end: int, ids: bool = False) -> DataFrame:
    """The pieces, with the CRC-32 of their ids, and the ids themselves (binary) if asked."""
    import pyarrow as pa

    tail = np.array([end], "<u4").tobytes()

    def pieces(batches):
        encoder = _encoder(path)
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = encoder.encode(text.as_py() or "") + tail
                for k, (start, length) in enumerate(cut(len(coded) // 4, capacity)):
                    own = coded[4 * start : 4 * (start + length)]
                    for name, value in (("doc_id", doc_id), ("piece", k), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own))):
                        out[name].append(value)
                    if ids:
                        out["ids"].append(own)
            kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * ids]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds], names=[n for n, _ in kinds])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES + ", ids binary" * ids)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (pieces of each size in a sequence) and how often to use each: the linear optimum, rounded down."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):  # the most valuable filling of each capacity
            best[c] = best[c - 1]
            for i, s in enumerate(sizes):
                if s <= c and (v := best[c - s] + price[i]) > best[c] + 1e-12:
                    best[c], take[c] = v, i
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= sizes[take[c]]
        direction, level = inverse @ column, inverse @ np.array(demand, float)
        ratio = np.where(direction > 1e-9, level / np.maximum(direction, 1e-9), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    level = np.linalg.inv(basis) @ np.array(demand, float)
    return [(tuple(int(x) for x in basis[:, j]), n) for j in range(k) if (n := int(max(0.0, level[j]) + 1e-6)) > 0]


Kinds = list[tuple[tuple[tuple[int, int], ...], int]]


def plan(counts: dict[int, int], capacity: int, groups: int = 24) -> Kinds:
    """Kinds of sequence: ((length, copies), ...) and how many sequences are of the kind.

    From which length a piece counts as large decides how much room rounding leaves to the small ones; of four such
    lengths the one with the fewest sequences is taken.
    """
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best: Kinds = []
    for part in (2, 4, 8, 16):
        found = _plan(counts, capacity, groups, capacity // part)
        if not best or sum(c for _, c in found) < sum(c for _, c in best):
            best = found
        if sum(c for _, c in best) <= least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> Kinds:
    """The number of kinds depends on the capacity and the groups, not on how many pieces there are."""
    left = {n: c for n, c in counts.items() if c > 0}
    kinds: Kinds = []
    if capacity in left:
        kinds.append((((capacity, 1),), left.pop(capacity)))

    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    sizes: list[int] = []
    members: list[list[list[int]]] = []  # of each group: [length, pieces], longest first
    at, last = 0, -1
    for n in large:
        c = left[n]
        while c:
            g = at * groups // total
            step = min(c, -(-(g + 1) * total // groups) - at)
            if g != last and (not sizes or sizes[-1] != n):  # groups of the same rounded length are one
                sizes.append(n)
                members.append([])
            members[-1].append([n, step])
            last, at, c = g, at + step, c - step

    bins: list[tuple[int, tuple[tuple[int, int], ...], int]] = []  # room, content, how many
    if sizes:
        for pattern, times in configurations(sizes, [sum(c for _, c in m) for m in members], capacity):
            slots = []
            for g, copies in enumerate(pattern):
                for _ in range(copies):
                    need, run = times, []
                    while need and members[g]:
                        n, c = members[g][0]
                        step = min(need, c)
                        run.append((n, step))
                        need -= step
                        if step == c:
                            members[g].pop(0)
                        else:
                            members[g][0][1] -= step
                        left[n] -= step
                    slots.append(run)
            borders = sorted({0, times, *(b for run in slots for b in np.cumsum([c for _, c in run]).tolist())})
            for lo, hi in zip(borders, borders[1:], strict=False):
                content: dict[int, int] = defaultdict(int)
                for run in slots:
                    b = 0
                    for n, c in run:
                        if b <= lo < b + c:
                            content[n] += 1
                        b += c
                if content:
                    bins.append((capacity - sum(n * c for n, c in content.items()), tuple(content.items()), hi - lo))

    rooms: dict[int, list] = defaultdict(list)
    for room, content, times in bins:
        rooms[room].append((content, times))
    free = sorted(rooms)

    def put(room: int, content: tuple, times: int) -> None:
        if not rooms[room]:
            insort(free, room)
        rooms[room].append((content, times))

    for n in sorted(left, reverse=True):  # best fit: the tightest sequence that holds the piece, else a new one
        c = left[n]
        while c:
            i = bisect_left(free, n)
            if i < len(free):
                room = free[i]
                content, times = rooms[room].pop()
                if not rooms[room]:
                    free.pop(i)
            else:
                room, content, times = capacity, (), c
            copies = min(room // n, c)
            full = min(times, c // copies)
            put(room - copies * n, (*content, (n, copies)), full)
            c -= full * copies
            if content and times > full:
                put(room, content, times - full)
    kinds += [(content, times) for room in rooms.values() for content, times in room]
    return kinds


def layout(counts: dict[int, int], kinds: Kinds) -> np.ndarray:
    """Rows (first rank, length, sequences, first sequence, offset) sorted by rank, for pieces ranked by length."""
    base, first = {}, 0
    for n in sorted(counts):
        base[n] = first
        first += counts[n]
    rows, sequence = [], 0
    for content, times in kinds:
        offset = 0
        for n, copies in content:
            rows.append((base[n], n, times, sequence, offset))
            base[n] += copies * times
            offset += copies * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, ids: bool = False, groups: int = 24) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece."""
    scratch = Scratch(docs.sparkSession, "pack")
    made = tokenise(docs, path, capacity, end, ids).withColumn("_key", F.xxhash64("doc_id", "piece", "ids_crc32"))
    made = scratch.keep(made, "made")  # dealing by ranges reads it twice
    dealt = ordered(made, ["length", "_key"], scratch, "pieces")
    counts = {r[0]: r[1] for r in dealt.groupBy("length").count().collect()}  # a number for each length up to the capacity
    table = layout(counts, plan(counts, capacity, groups))

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy()
        row = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
        copy, own = np.divmod(rank - row[:, 0], row[:, 2])
        return pd.DataFrame({"sequence_id": row[:, 3] + own, "offset": row[:, 4] + copy * row[:, 1]})

    ranked = running(dealt.withColumn("_one", F.lit(1).cast("long")), ["length", "_key"], {"_rank": "_one"})
    names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * ids
    return ranked.withColumn("_place", place("_rank")).select(*names, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (binary) of the packed sequences; packed must hold the ids. A group is at most one sequence."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", "length", F.expr("aggregate(transform(_parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))
