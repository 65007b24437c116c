"""Document fingerprints: the k smallest distinct hashes of a text's word shingles (bottom-k), in DataFrame functions only.

Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and the number of distinct
shingles. Shingles take five words; a text with fewer words is one shingle, a text without words has none.

Defined results: a null text is an empty one; two empty sketches are alike (1.0), an empty and another one aren't (0.0).
edits(): documents are ordered by (doc_id, hash of the text), null ids first; rows equal in both are one document in that
order, and each of them is returned. A document that stands alone is its own next one. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, neighbours, ordered, text_or_empty

SIZE = 128
WORDS = 5


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, words: int = WORDS) -> Column:
    """Of an array column of word hashes (a column, not an expression: it is used once for each place of a shingle)."""
    n = F.size(hashes)
    parts = F.transform(hashes, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, words))))
    return F.when(n >= words, F.slice(parts, F.lit(1), F.greatest(n - (words - 1), F.lit(0)))).when(n > 0, F.array(F.xxhash64(F.array_join(hashes.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))


def lowest(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def with_sketch(df: DataFrame, text: str, name: str, size: int = SIZE, words: int = WORDS) -> DataFrame:
    df = df.withColumn("_words", word_hashes(F.col(text)))
    return df.withColumn(name, lowest(shingle_hashes(F.col("_words"), words), size)).drop("_words")


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Jaccard likeness: the share of the merged sketch that is in both."""
    both = merge(a, b, size)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact while the sketch isn't full."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / F.greatest(share, F.lit(1e-18)))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    shared = resemblance(a, b, size) * distinct(merge(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct(a, size)))


def merge_all(groups: DataFrame, by: list[str], sketch: str, size: int = SIZE) -> DataFrame:
    """One sketch for each group of by: hashes are counted apart, so that no group meets in one array before it is cut."""
    from pyspark.sql import Window

    rows = groups.select(*by, F.explode(sketch).alias("_hash")).distinct()
    salted = Window.partitionBy(*by, F.pmod("_hash", F.lit(64))).orderBy("_hash")
    rows = rows.withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= size)
    return rows.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("_hash")), 1, size).alias(sketch))


def text_form(a: Column) -> Column:
    """As a string: each hash as 16 hex digits."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


KEY = ["_id", "_null", "_hash"]


def edits(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Each document, its edited text (its second half replaced by the start of the next document) and their sketches.

    doc_id, n_chars, edited_text, sketch, edited_sketch, next_sketch. The order is found over ids alone; then a document's
    start and sketch go to the one before it. Both joins deal the texts by the same key, so that they are shuffled once.
    """
    scratch = Scratch(docs.sparkSession, "sketch")
    text = text_or_empty()
    keyed = docs.select("doc_id", text.alias("text"))
    key = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_null": F.col("doc_id").isNotNull(), "_hash": F.xxhash64("text")}
    kind = dict(docs.dtypes)["doc_id"]
    ids = keyed.select(F.length("text").alias("_n"), *(c.alias(n) for n, c in key.items())).groupBy(*KEY).agg(F.max("_n").alias("_n"), F.count("*").alias("_rows"))
    order = ["_null", "_id", "_hash"]
    dealt = ordered(scratch.keep(ids, "units"), order, scratch, "ids")
    again = dealt.agg(F.max("_rows")).first()[0] or 0
    # of each document as the next one: whom it follows, and how much that one takes
    chain = neighbours(dealt, order, [*KEY, "_n"], ring=True).select(*KEY, *(F.col(f"_before.{k}").alias(f"to{k}") for k in KEY), F.floor(F.col("_before._n") / 2).cast("int").alias("_take"))
    chain = scratch.keep(chain, "chain")

    texts = keyed.select(*(c.alias(n) for n, c in key.items()), "text").repartition(*KEY)  # the same columns in both uses: one shuffle
    follow = texts.join(chain, KEY).withColumn("_start", F.substring(F.col("text"), F.lit(1), F.col("_take")))
    follow = with_sketch(follow, "text", "next_sketch", size).select(*(F.col(f"to{k}").alias(k) for k in KEY), "_start", "next_sketch")
    if again > 1:  # rows that stand more than once
        follow = follow.dropDuplicates(KEY)
    rows = with_sketch(texts, "text", "sketch", size).join(follow, KEY)
    n = F.length("text")
    rows = rows.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), "_start"))
    rows = with_sketch(rows, "edited_text", "edited_sketch", size)
    return rows.select(F.when(F.col("_null"), F.col("_id")).cast(kind).alias("doc_id"), n.cast("long").alias("n_chars"), "edited_text", "sketch", "edited_sketch", "next_sketch")
