"""Removing strings that repeat, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `width` bytes, most significant digits first; those still together after the
last digit are exactly the repeated windows. Sorting every suffix would shuffle many times the text, so the passes go over
anchors: positions whose k-byte string has the least hash among those of some window. Equal windows have the same anchors at
the same places, so nothing is lost by it.

1. The first digit is the anchor's k-byte string. Anchors alone in their group are in no repeated window.
2. An anchor's context is all that the windows that hold the anchor can reach. Where contexts are equal as a whole, every
   window in them is repeated.
3. Groups with different contexts go on by digits of the windows' place: first the bytes that all windows of a run of places
   share, then, where these are equal, each window's own. A group of up to SMALL contexts is sorted in one task, by the bytes
   themselves; larger ones by two passes of distributed counts of hashes, in which equal contexts of a run are one.

Windows that hold an equal one elsewhere mark their bytes, in every document and also the first time.

Defined results: a null text is an empty one. Rows equal in doc_id and text are different documents with equal strings.
Texts shorter than the width keep all. An empty table gives an empty result. apply() keeps every column of its input,
whatever its name. Texts are read in blocks, whole and however long; what is kept of a text in a row are its maximal runs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, renamed, sliced, text_or_empty

WIDTH = 400
#: Different contexts of a group that is sorted in one task: their bytes are under a MB.
SMALL = 256
#: Places of a window that share the digit before the last.
RUN = 16
#: Anchors are found in blocks of so many places, so that memory doesn't grow with the text.
BLOCK = 1 << 17
KEY = ["_id", "_hash"]

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def anchor_width(width: int) -> int:
    return max(1, width * 5 // 16)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _tables:
        ups = np.full(size, _BASE, np.uint64)
        downs = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        ups[0] = downs[0] = 1
        _tables[size] = np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)
    return _tables[size]


def _slide(values: np.ndarray, n: int, of) -> np.ndarray:
    """The least or largest of each n values in a row."""
    size = 1
    while size * 2 <= n:
        values = of(values[:-size], values[size:])
        size *= 2
    return of(values[: len(values) - (n - size)], values[n - size :]) if n > size else values


def anchors(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and the hashes of their k-byte strings. Of equal least hashes in a window each is an anchor."""
    k = anchor_width(width)
    reach = width - k + 1  # k-byte strings in a window
    at, hashes = [], []
    for first in range(0, len(text) - width + 1, BLOCK):
        own = np.frombuffer(text, np.uint8, min(len(text) - first, BLOCK + width - 1), first)
        ups, downs = _powers(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTES[own] * ups[: len(own)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * downs[: len(own) - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        least = np.pad(_slide(h, reach, np.minimum), reach - 1)
        found = np.flatnonzero(_slide(least, reach, np.maximum) == h)
        at.append(found + first)
        hashes.append(h[found])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = np.concatenate(at), np.concatenate(hashes)
    if len(at) > 1:
        places, keep = np.unique(places, return_index=True)
        hashes = hashes[keep]
    return places, hashes


def _coded(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """Of each anchor: its document, first digit g, the hash c of its context, and in one number its place and how far right (lo) and left (hi) the context reaches."""
    reach = width - anchor_width(width) + 1

    def rows(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in sliced(batches):
            counts, at, groups, contexts = [], [], [], []
            for text in batch.column(2):
                coded = _coded(text.as_py())
                places, hashes = anchors(coded, width)
                low, high = np.maximum(0, places + width - len(coded)), np.minimum(reach - 1, places)
                counts.append(len(places))
                at.append(places << 32 | low << 16 | high)
                groups.append(hashes)
                cut = zip((places - high).tolist(), (places - low + width).tolist(), (low << 16 | high).tolist(), strict=True)
                contexts.append(np.array([digest(coded[a:b], seed) for a, b, seed in cut], np.uint64))
            repeat = pa.array(np.repeat(np.arange(len(counts)), counts))
            bits = lambda parts: pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))
            places = pa.array(np.concatenate([np.zeros(0, np.int64), *at]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(repeat), batch.column(1).take(repeat), places, bits(groups), bits(contexts)], names=[*KEY, "place", "g", "c"])

    return docs.select(*KEY, "text").mapInArrow(rows, "_id long, _hash long, place long, g long, c long")


def _at() -> dict:
    """Columns of what place packs."""
    place = F.col("place")
    return {"at": F.shiftright(place, 32), "lo": F.shiftright(place, 16).bitwiseAND(0xFFFF).cast("short"), "hi": place.bitwiseAND(0xFFFF).cast("short")}


def _contexts(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """item, g, alone, hot, lo, hi and the bytes of each item's context, cut from one text that has it."""
    wanted = items.groupBy(*KEY).agg(F.collect_list(F.struct("item", "g", "place", "alone", "hot")).alias("_items"))  # at most the anchors of a text
    texts = docs.select(*KEY, "text").join(wanted.hint("merge"), KEY).select("text", "_items")
    again = docs.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()

    def rows(batches):
        import pyarrow as pa

        kinds = [("item", pa.int64()), ("g", pa.int64()), ("alone", pa.bool_()), ("hot", pa.bool_()), ("lo", pa.int16()), ("hi", pa.int16()), ("context", pa.binary())]
        for batch in sliced(batches):
            out: dict[str, list] = {n: [] for n, _ in kinds}
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                coded = _coded(text.as_py())
                for x in own.as_py():
                    for n in ("item", "g", "alone", "hot"):
                        out[n].append(x[n])
                    at, lo, hi = x["place"] >> 32, x["place"] >> 16 & 0xFFFF, x["place"] & 0xFFFF
                    out["lo"].append(lo)
                    out["hi"].append(hi)
                    out["context"].append(coded[at - hi : at - lo + width])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds], names=list(out))

    found = texts.mapInArrow(rows, "item long, g long, alone boolean, hot boolean, lo short, hi short, context binary")
    return found.dropDuplicates(["item"]) if again else found  # equal rows give their contexts each


def _runs(reach: int) -> list[tuple[int, int]]:
    return [(a, min(a + RUN, reach) - 1) for a in range(0, reach, RUN)]


def _ranges(places: list[int]) -> Iterator[tuple[int, int]]:
    places = sorted(places)
    start = last = None
    for p in places:
        if last is None or p > last + 1:
            if last is not None:
                yield start, last
            start = p
        last = p
    if last is not None:
        yield start, last


def repeated_places(group: list[tuple[int, int, int, bytes]], width: int) -> dict[int, list[int]]:
    """Of a group of different contexts (item, lo, hi, bytes): the places at which an item's window is equal to another's."""
    found: dict[int, list[int]] = defaultdict(list)
    for first, last in _runs(width - anchor_width(width) + 1):
        cores = defaultdict(list)
        for i, (_, lo, hi, context) in enumerate(group):
            if lo <= last and hi >= first:
                cores[context[hi - first : hi - last + width]].append(i)
        for own in cores.values():
            if len(own) < 2:
                continue
            for place in range(first, last + 1):
                windows = defaultdict(list)
                for i in own:
                    item, lo, hi, context = group[i]
                    if lo <= place <= hi:
                        windows[context[hi - place : hi - place + width]].append(item)
                for same in windows.values():
                    if len(same) > 1:
                        for item in same:
                            found[item].append(place)
    return found


def _small(contexts: DataFrame, width: int) -> DataFrame:
    def rows(batches):
        import pyarrow as pa

        def flush(group, alone):
            if len(group) > 1 and alone:
                for item, places in repeated_places(group, width).items():
                    if item in alone:
                        for a, b in _ranges(places):
                            out.append((item, a, b))

        out: list[tuple[int, int, int]] = []
        last, group, lonely = None, [], set()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int16(), pa.int16()))], names=["item", "lo", "hi"])
        for batch in batches:
            for g, item, alone, lo, hi, context in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if g != last:
                    flush(group, lonely)
                    last, group, lonely = g, [], set()
                group.append((item, lo, hi, context))
                if alone:
                    lonely.add(item)
            yield done()
            out = []
        flush(group, lonely)
        yield done()

    dealt = contexts.repartition("g").sortWithinPartitions("g").select("g", "item", "alone", "lo", "hi", "context")
    return dealt.mapInArrow(rows, "item long, lo short, hi short")


def _large(contexts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The same for groups of any size: by counts of the hashes of runs of places, then of single places.

    As with whole contexts, where all that a run's windows reach (its hull) is equal, every window of the run is repeated;
    and of equal hulls one goes on for all.
    """
    runs = _runs(width - anchor_width(width) + 1)

    def digits(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for item, alone, lo, hi, context in zip(*(batch.column(n).to_pylist() for n in ("item", "alone", "lo", "hi", "context")), strict=True):
                for r, (a, b) in enumerate(runs):
                    if lo <= b and hi >= a:
                        first, last = max(lo, a), min(hi, b)
                        hull = digest(context[hi - last : hi - first + width], first << 16 | last)
                        out.append((item, alone, r, digest(context[hi - a : hi - b + width]) - (1 << 63), hull - (1 << 63)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int16(), pa.int64(), pa.int64()))], names=["item", "alone", "run", "core", "hull"])

    rows = scratch.keep(contexts.mapInArrow(digits, "item long, alone boolean, run short, core long, hull long"), "runs")
    hulls = scratch.keep(rows.groupBy("run", "core", "hull").agg(F.count("*").alias("n"), F.min("item").alias("item")), "hulls")
    starts, ends = (F.array(*(F.lit(r[i]).cast("short") for r in runs)) for i in (0, 1))
    met = rows.filter("alone").join(hulls.filter("n > 1").select("run", "core", "hull"), ["run", "core", "hull"])
    whole = met.select("item", starts[F.col("run").cast("int")].alias("lo"), ends[F.col("run").cast("int")].alias("hi"))
    open_ = hulls.groupBy("run", "core").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).filter("kinds > 1 and fewest = 1")
    going = hulls.join(open_.select("run", "core"), ["run", "core"]).groupBy("item").agg(F.collect_list("run").alias("runs"))  # at most all runs

    def windows(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out = []
            for item, g, lo, hi, context, own in zip(*(batch.column(n).to_pylist() for n in ("item", "g", "lo", "hi", "context", "runs")), strict=True):
                for r in own:
                    for p in range(max(lo, runs[r][0]), min(hi, runs[r][1]) + 1):
                        out.append((item, g, p, xxhash.xxh3_64_intdigest(context[hi - p : hi - p + width]) - (1 << 63)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int16(), pa.int64()))], names=["item", "g", "place", "w"])

    second = scratch.keep(contexts.join(going, "item").mapInArrow(windows, "item long, g long, place short, w long"), "windows")
    equal = second.groupBy("g", "place", "w").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    alone = contexts.filter("alone").select("item")
    single = second.join(equal, ["g", "place", "w"]).join(alone, "item").select("item", F.col("place").alias("lo"), F.col("place").alias("hi"))
    return scratch.keep(whole.unionAll(single), "large")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "_hash": F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())})


def spans(docs: DataFrame, width: int = WIDTH, limit: int = SMALL) -> DataFrame:
    """KEY and spans: of each document with repeated windows, the (first, end) of its maximal runs of their bytes, in order.

    docs: KEY and text. Counts are written before they are joined, so that adaptive execution can split a frequent digit.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    every = scratch.keep(_anchor_rows(docs, width), "anchors")
    twice = scratch.keep(every.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "twice")
    met = scratch.keep(every.join(twice, "g"), "met")
    scratch.drop("anchors")
    scratch.drop("twice")

    items = met.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "place")).alias("one"))
    items = scratch.keep(items.select("g", "c", "n", "one.*", F.monotonically_increasing_id().alias("item")), "items")
    groups = scratch.keep(items.groupBy("g").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).filter("kinds > 1 and fewest = 1"), "groups")
    mixed = items.join(groups, "g").select("item", "g", *KEY, "place", (F.col("n") == 1).alias("alone"), (F.col("kinds") > limit).alias("hot"))
    mixed = scratch.keep(mixed, "mixed")
    cut = scratch.keep(_contexts(docs, mixed, width), "contexts")
    parts = scratch.keep(_small(cut.filter("not hot"), width), "small")
    if mixed.filter("hot").limit(1).count():
        parts = parts.unionAll(_large(cut.filter("hot"), width, scratch))
    reach = {"first": F.col("at") - F.col("hi"), "end": F.col("at") - F.col("lo") + width}
    # the windows at an item's places overlap one another, as the places are fewer than a window's bytes: together they are one run
    parts = parts.groupBy("item").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bounds = items.filter("n = 1").withColumns(_at()).select("item", *KEY, "at", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    single = bounds.join(parts, "item").withColumns({"lo": F.greatest("lo", "_lo"), "hi": F.least("hi", "_hi")}).select(*KEY, *(v.alias(k) for k, v in reach.items()))
    whole = met.join(items.filter("n > 1").select("g", "c"), ["g", "c"]).withColumns(_at()).select(*KEY, *(v.alias(k) for k, v in reach.items()))
    runs = scratch.keep(islands(single.unionAll(whole)), "islands")
    for name in ("met", "items", "groups", "mixed", "contexts", "small", "runs", "hulls", "windows", "large"):
        scratch.drop(name)
    return runs


def islands(found: DataFrame) -> DataFrame:
    """KEY and spans: the maximal runs of the spans (first, end) of each document."""
    before = Window.partitionBy(*KEY).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("_new", F.coalesce((F.col("first") > F.max("end").over(before)).cast("long"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(upto)).groupBy(*KEY, "_run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))


def merged(found) -> list[tuple[int, int]]:
    return [(x["first"], x["end"]) for x in (found if found is not None else ())]


def with_spans(docs: DataFrame, width: int = WIDTH, limit: int = SMALL) -> DataFrame:
    """docs with KEY and _spans."""
    rows = keyed(docs)
    found = spans(rows.select(*KEY, text_or_empty().alias("text")), width, limit).withColumnRenamed("spans", "_spans")
    return rows.join(found.hint("merge"), KEY, "left")  # dealt alike at every size


def _kept(text, runs) -> bytes:
    coded, at, parts = _coded(text), 0, []
    for a, b in runs:
        parts.append(coded[at:a])
        at = b
    return b"".join([*parts, coded[at:]])


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs removed), the SHA-256 of what is kept, and what is kept as text.

    In the text half a character at a cut goes; the digest is of all bytes that are kept.
    """

    def digest(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
        for batch in sliced(batches):
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = merged(own)
                kept = _kept(text, runs)
                out.append((len(_coded(text)), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    rows = with_spans(docs.select("doc_id", "text"), width).select("doc_id", "text", "_spans")
    return rows.mapInArrow(digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def apply(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the texts that are left, and n_chars, if there is such a column, set to their length.

    Half a character at a cut goes too. A text that is wholly removed stays as an empty one; a null text stays null.
    """

    names = docs.columns
    at = names.index("text")
    rows = renamed(docs).withColumns({"doc_id": F.col(f"c{names.index('doc_id')}"), "text": F.col(f"c{at}")})
    rows = with_spans(rows, width).select(*(f"c{i}" for i in range(len(names))), "_spans")

    def left(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            texts = [t if own is None else _kept(t, merged(own)).decode("utf-8", "ignore") for t, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            own = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(own, names=[f"c{i}" for i in range(len(names))])

    rows = rows.mapInArrow(left, rows.drop("_spans").schema)
    if "n_chars" in names:
        rows = rows.withColumn(f"c{names.index('n_chars')}", F.length(f"c{at}").cast(dict(docs.dtypes)["n_chars"]))
    return rows.toDF(*names)
