"""Joins of token sets by their F1: prefix filters over a global order of tokens instead of comparing all pairs, and clusters.

Tokens are ordered by how many sets have them, rare ones first. Two sets of an F1 of t share at least t / (2 - t) of either's
tokens, so that they meet in a token of both sets' prefixes, which leave out that many less one of the most frequent tokens;
sizes and the token's places bound what the rest can add. A pair is made where it first meets, and its sets stand there, so
that no counts of pairs are shuffled. Equal sets are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_folder

#: Below any difference of an F1 of sets, above what arithmetic loses.
_EPSILON = 1e-9


def frequencies(sets: DataFrame, tokens: str = "_set", by: list[str] = ()) -> DataFrame:
    """by, _token, _n: in how many rows of sets a token is."""
    return sets.select(*by, F.explode(tokens).alias("_token")).groupBy(*by, "_token").agg(F.count("*").alias("_n"))


def in_order(sets: DataFrame, key: str, counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, key, _set: tokens by frequency, those without a count first. Rows without tokens go; keys are unique."""
    rows = sets.select(*by, key, F.explode("_set").alias("_token")).join(counts.hint("merge"), [*by, "_token"], "left")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("t"))))
    return rows.groupBy(*by, key).agg(F.transform(ranked, lambda x: x["t"]).alias("_set"))


def _prefixes(rows: DataFrame, key: str, name: str, least: float, by: list[str]) -> DataFrame:
    n = F.size("_set")
    kept = F.least(n, n - F.ceil(n * (least / (2 - least)) - _EPSILON).cast("int") + 1)
    own = rows.select(*by, F.col(key).alias(name), F.col("_set").alias(f"_{name}"), F.posexplode(F.slice("_set", F.lit(1), kept)).alias(f"_at_{name}", "_token"))
    return own


def meet(left: DataFrame, right: DataFrame, a: str, b: str, least: float, by: list[str] = (), where: Column | None = None) -> DataFrame:
    """a, b, f1 of pairs of ordered sets (in_order() of the same counts) with an F1 of least or more."""
    joined = _prefixes(left, a, "a", least, by).join(_prefixes(right, b, "b", least, by), [*by, "_token"])
    if where is not None:
        joined = joined.filter(where)
    na, nb = F.size("_a"), F.size("_b")
    bound = F.least(na - F.col("_at_a"), nb - F.col("_at_b"))  # this token and all after it
    joined = joined.filter(2 * bound >= least * (na + nb) - _EPSILON)
    joined = joined.withColumn("_both", F.array_intersect("_a", "_b")).filter(F.col("_both")[0] == F.col("_token"))
    return joined.select(*by, "a", "b", (2 * F.size("_both") / (na + nb)).alias("f1")).filter(F.col("f1") >= least)


def _size(n: Column) -> Column:
    """Classes of sizes, in their order: small ones by themselves, then four to each doubling."""
    return F.when(n <= 16, n).otherwise(F.floor(4 * F.log2(n))).cast("int")


def nearest(queries: DataFrame, index: DataFrame, a: str, b: str) -> DataFrame:
    """a, _m (b, f1): of each ordered set (a, _set, _least) the set (b, _set) of the highest F1, of `_least` or more, the smaller b on ties.

    A query whose first common token with an entry is its p-th can have no more in common than what is left of it, which
    bounds the entry's size: the more frequent the token, the smaller the entries that it is met in. Sizes are part of the
    join's key, so that entries beyond the bound are not met at all. A pair that meets in several tokens counts by its first.
    """
    na, nb = F.size("_sa"), F.size("_sb")
    left = queries.select(F.col(a).alias("a"), "_least", F.size("_set").alias("na"), "_set", F.posexplode("_set").alias("_p", "_token"))
    bound = F.floor(2 * (F.col("na") - F.col("_p")) / F.col("_least") - F.col("na") + _EPSILON)
    left = left.withColumn("_bound", bound).filter("_bound >= 1").withColumn("_sa", F.expr("slice(_set, _p + 1, na)"))
    left = left.select("a", "_least", "na", "_bound", "_sa", "_token", F.explode(F.sequence(F.lit(1), _size(F.col("_bound")))).alias("_size"))
    right = index.select(F.col(b).alias("b"), F.size("_set").alias("nb"), "_set", F.posexplode("_set").alias("_p", "_token"))
    right = right.select("b", "nb", F.expr("slice(_set, _p + 1, nb)").alias("_sb"), "_token", _size(F.col("nb")).alias("_size"))
    both = left.join(right.hint("merge"), ["_token", "_size"])
    both = both.filter((F.col("nb") <= F.col("_bound")) & (2 * F.least(na, nb) >= F.col("_least") * (F.col("na") + F.col("nb")) - _EPSILON))
    both = both.select("a", "b", "_least", (2 * F.size(F.array_intersect("_sa", "_sb")) / (F.col("na") + F.col("nb"))).alias("f1")).filter(F.col("f1") >= F.col("_least") - _EPSILON)
    return both.groupBy("a").agg(F.max_by(F.struct("b", "f1"), F.struct("f1", -F.col("b"))).alias("_m"))


def kept(df: DataFrame, path: str) -> DataFrame:
    """The rows, written and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def f1_pairs(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """a < b, f1: pairs of rows whose token sets have an F1 of `least` or more.

    Rows with equal sets are one in the join (a frequent title doesn't pair with itself), and pairs of sets come back as
    pairs of the sets' first rows; members of one set pair with its first row, with an F1 of 1. The sets are written to the
    shared folder, as they are read several times and may be dear to make.
    """
    folder = scratch_folder(df.sparkSession)
    rows = kept(df.select(key, F.array_sort(tokens).alias("_set")), f"{folder}/rows")
    sets = rows.groupBy("_set").agg(F.min(key).alias("_first"))
    same = rows.join(sets, "_set").filter(F.col(key) != F.col("_first")).select(F.col("_first").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("f1"))
    ranked = kept(in_order(sets, "_first", frequencies(sets)), f"{folder}/ranked")
    return meet(ranked, ranked, "_first", "_first", least, where=F.col("a") < F.col("b")).unionAll(same)


def _indexed(queries: DataFrame, index: DataFrame, key: str, entry: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows of the queries, their distinct sets, and these and the entries' in order, written to the shared folder."""
    folder = scratch_folder(queries.sparkSession)
    asked = kept(queries.select(key, F.array_sort("tokens").alias("_set")), f"{folder}/asked")
    sets = asked.groupBy("_set").agg(F.min(key).alias("_q"))
    entries = kept(index.select(entry, F.array_sort("tokens").alias("_set")).groupBy("_set").agg(F.min(entry).alias("_e")), f"{folder}/entries")
    counts = kept(frequencies(entries), f"{folder}/counts")
    return asked, sets, kept(in_order(sets, "_q", counts), f"{folder}/q"), kept(in_order(entries, "_e", counts), f"{folder}/e")


def _status(f1: Column) -> Column:
    return F.when(f1 >= 0.85, "covered").when(f1 >= 0.45, "partial").otherwise("gap")


def statuses(queries: DataFrame, index: DataFrame, key: str, entry: str) -> DataFrame:
    """key, status of best_match(), for which matches below 0.45 needn't be known."""
    asked, sets, q, e = _indexed(queries, index, key, entry)
    near = nearest(q.withColumn("_least", F.lit(0.45)), e, "_q", "_e")
    found = sets.join(near, F.col("_q") == F.col("a"), "left").select("_set", "_m.f1")
    return asked.join(found.hint("merge"), "_set", "left").select(key, _status(F.coalesce("f1", F.lit(0.0))).alias("status"))


def best_match(queries: DataFrame, index: DataFrame, key: str, entry: str, first: float = 0.45) -> DataFrame:
    """Of each query (key, tokens) the entry (entry, tokens) of the highest F1, the smaller on ties, and its status.

    status: covered from 0.85, partial from 0.45, else gap; the match is kept from 0.30. Queries without a match of `first`
    or more have one at least as good as the smallest entry that holds one of their tokens, and meet entries that are
    better. Of equal sets of entries the smallest stands for all. Sets and first matches are written to the shared folder.
    """
    asked, sets, q, e = _indexed(queries, index, key, entry)
    folder = scratch_folder(queries.sparkSession)
    near = kept(nearest(q.withColumn("_least", F.lit(first)), e, "_q", "_e"), f"{folder}/near")
    open_ = q.join(near.select(F.col("a").alias("_q")).hint("merge"), "_q", "left_anti")
    small = e.select(F.struct(F.size("_set").alias("n"), F.col("_e").alias("b")).alias("_s"), F.explode("_set").alias("_token")).groupBy("_token").agg(F.min("_s").alias("_s"))
    single = open_.select("_q", F.size("_set").alias("na"), F.explode("_set").alias("_token")).join(small.hint("merge"), "_token").groupBy("_q", "na").agg(F.min("_s").alias("_s"))
    single = kept(single.select("_q", F.struct(F.col("_s.b").alias("b"), (2 / (F.col("na") + F.col("_s.n"))).alias("f1")).alias("_m")), f"{folder}/single")
    better = nearest(open_.join(single.select("_q", F.col("_m.f1").alias("_least")).hint("merge"), "_q"), e, "_q", "_e")
    rest = single.select(F.col("_q").alias("a"), "_m").unionAll(better).groupBy("a").agg(F.max_by("_m", F.struct("_m.f1", -F.col("_m.b"))).alias("_m"))
    found = sets.join(near.unionAll(rest), F.col("_q") == F.col("a"), "left").select("_set", "_m")
    rows = asked.join(found.hint("merge"), "_set", "left")
    f1 = F.coalesce("_m.f1", F.lit(0.0))
    return rows.select(key, _status(f1).alias("status"), F.when(f1 >= 0.3, F.col("_m.b")).alias("match"), T.rounded(f1, 2).alias("score"))


def clusters(pairs: DataFrame, scratch: str) -> DataFrame:
    """node, root: the smallest node that the pairs (a < b) connect each node with, by rounds of large and small stars."""
    edges, turn, before = kept(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), f"{scratch}/edges"), 0, None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before, turn = now, turn + 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = kept(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{scratch}/large{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = small.select("u", F.col("m").alias("v")).unionAll(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        edges = kept(edges, f"{scratch}/small{turn}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def leaders(pairs: DataFrame, scratch: str) -> DataFrame:
    """leader, member: greedy clusters of pairs (a < b): in order, each node not taken leads those near it that aren't.

    Whether a node leads hangs on all smaller ones that it is connected with, so a chain can't be cut into rounds. Pairs are
    dealt by what is connected, in a number of jobs that grows with the logarithm of the longest chain, and a task passes over
    each cluster once, in order, holding the numbers of its members. Tables of the rounds are written below the folder `scratch`.
    """
    pairs = kept(pairs.select("a", "b").distinct(), f"{scratch}/pairs")
    named = clusters(pairs, scratch)
    rows = pairs.join(named.select(F.col("node").alias("b"), "root"), "b")
    rows = rows.repartition("root").sortWithinPartitions("root", "b", "a").select("root", "a", "b")

    def solve(batches):
        import pyarrow as pa

        root, members, last = None, set(), None
        for batch in batches:
            found = ([], [])
            for own, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != root:
                    root, members, last = own, set(), None
                # the smaller node has met all that are smaller still: it leads unless one of them leads it
                if b != last and a not in members:
                    last = b
                    members.add(b)
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["leader", "member"])

    return rows.mapInArrow(solve, "leader long, member long")
