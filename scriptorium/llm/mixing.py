"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted by (source, key). Distributed prefix sums of their sizes find, for
each source, the key at which its budget is used up; every document is then judged by comparing its key with its source's
cut, so that texts are never shuffled. A budget over a source's size takes whole epochs first.

Defined results: null sources form one source, ordered last; a null text has size 0; sources of size 0 have target 0.
Rows equal in doc_id and text share one key: they are cut together, and at the cut each gets an equal part.
An empty table gives an empty mix. Only doc_id, source and text are read, further columns pass through apply(), whatever
their names. Texts of any length are counted on the JVM; what reaches the driver are samples for range borders (Spark's, of a
size by partitions) and totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, ordered, renamed, running, text_or_empty

#: source, null or not, as columns that join and sort
SOURCE = ["_none", "_source"]


def _sizes(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with its words (size), its random key and its source as columns that join and sort."""
    named = {"_none": F.col(source).isNull(), "_source": F.coalesce(source, F.lit(""))}
    return docs.withColumns({"size": word_count(text), "_key": F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text)), **named})


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(totals: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """totals (_none, _source, source_size) with each source's target.

    The sources, ordered, take the weights in turn; they share `share` times all sizes by weight. A target stops at `epochs`
    times its source's size and the excess goes to the others: the level L at which the sum of min(cap, weight * L) is the
    whole is found in one pass over the sources ordered by cap / weight, with prefix sums.
    """
    dealt = ordered(totals, SOURCE, scratch, "sources")
    n = F.lit(len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % n + 1).cast("int")).cast("double")
    ranked = running(dealt.withColumn("_one", F.lit(1)), SOURCE, {"_rank": "_one"}).drop("_one", "_range")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("_level", F.col("cap") / F.col("weight"))
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    by_level = ordered(ranked.drop("_rank"), ["_level", *SOURCE], scratch, "levels")
    filled = running(by_level, ["_level", *SOURCE], {"_caps": "cap", "_weights": "weight"})
    level = (F.lit(share * float(total or 0)) - F.col("_caps")) / (F.lit(float(all_weights or 0)) - F.col("_weights"))
    # the first source that isn't filled fixes the level; where all are filled there is none
    first = filled.withColumn("_at", level).filter("_at <= _level").agg(F.min_by("_at", F.struct("_level", *SOURCE))).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.col("weight") * F.lit(first))
    return ranked.select(*SOURCE, "source_size", target.alias("target"))


def plan(sizes: DataFrame, scratch: Scratch, whole: bool = False, **shares) -> DataFrame:
    """For each source: source_size, target, epochs (taken whole), cut (the key where the rest ends), part, at_cut.

    sizes: _none, _source, _key, size. A key below the cut is taken once more; of the one at the cut, `part` words of each
    row. whole: the one at the cut is taken whole if that comes nearer to the target, else not at all.
    """
    totals = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    sources = scratch.keep(targets(totals, scratch, **shares), "targets")
    units = sizes.groupBy(*SOURCE, "_key").agg(F.sum("size").alias("_words"), F.count("*").alias("_rows"))
    dealt = ordered(units, [*SOURCE, "_key"], scratch, "keys")
    before = running(dealt, ["_key"], {"_before": "_words"}, by=SOURCE)
    budget = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("_rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    rest = F.col("_rest") - F.col("_before")
    at = before.join(sources.select(*SOURCE, "_rest"), SOURCE).filter((F.col("_before") < F.col("_rest")) & (rest <= F.col("_words")))
    part = F.floor(rest / F.col("_rows")).cast("long")
    if whole:
        part = F.when(rest * 2 >= F.col("_words"), F.lit(None).cast("long")).otherwise(0)  # null: all its words
    cuts = at.select(*SOURCE, F.col("_key").alias("cut"), part.alias("part"))
    return sources.drop("_rest").join(cuts, SOURCE, "left")


def _extra() -> Column:
    """Words of a row that are taken besides whole epochs."""
    return F.when(F.col("cut").isNull(), 0).when(F.col("_key") < F.col("cut"), F.col("size")).when(F.col("_key") == F.col("cut"), F.least("size", F.coalesce("part", "size"))).otherwise(0)


def mix(docs: DataFrame, seed: int = 42, **shares) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken: what the mix takes of each document, in words."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.keep(_sizes(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    cuts = scratch.keep(plan(sizes, scratch, **shares), "plan")
    rows = sizes.join(cuts, SOURCE)
    taken = F.col("epochs") * F.col("size") + _extra()
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"))


def apply(docs: DataFrame, seed: int = 42, **shares) -> DataFrame:
    """The mixed documents themselves: each as often as the mix takes it, with the columns of docs.

    Documents stay whole; the one at a source's cut is taken if that comes nearer to the target.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = docs.columns
    keyed = _sizes(renamed(docs), seed, *(f"c{names.index(n)}" for n in ("doc_id", "text", "source")))
    sizes = scratch.keep(keyed.select(*SOURCE, "_key", "size"), "sizes")
    cuts = scratch.keep(plan(sizes, scratch, whole=True, **shares), "plan")
    again = F.when(F.col("cut").isNull(), 0).when(F.col("_key") < F.col("cut"), 1).when((F.col("_key") == F.col("cut")) & F.col("part").isNull(), 1).otherwise(0)
    rows = keyed.join(cuts, SOURCE).withColumn("_times", (F.col("epochs") + again).cast("int"))
    return rows.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
