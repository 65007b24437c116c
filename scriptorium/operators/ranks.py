"""Sums over all rows in order, with no task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many ranges values are dealt into: tasks of a sum in order, and the length of the arrays of bounds and totals.
RANGES = 200


def running(df: DataFrame, value: str, sums: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """df with, for each name: column of sums, the sum of the column over the rows of a lower value. Nulls come first.

    value: a number or a time, each once (a histogram). Ranges are bounded by approximate percentiles, so that they hold about as
    many values each; the bounds are data of the plan, so that a lost task deals the rows as before. Within a range the sums
    run in a window, and the totals of the ranges below, `ranges` numbers, are added.
    """
    at = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    bounds = df.agg(F.approx_percentile(value, at, 100 * ranges).alias("_bounds"))
    below = F.size(F.filter(F.coalesce("_bounds", F.slice("_bounds", 1, 0)), lambda b: b <= F.col(value)))
    dealt = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.greatest(F.coalesce(below, F.lit(0)), F.lit(0))).drop("_bounds")
    totals = dealt.groupBy("_range").agg(*(F.sum(of).alias(name) for name, of in sums.items()))
    totals_of = totals.schema
    totals = totals.agg(F.collect_list(F.struct("*")).alias("_totals"))
    within = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.crossJoin(F.broadcast(totals))

    def before(name: str, of: str) -> Column:
        lower = F.filter("_totals", lambda t: t["_range"] < F.col("_range"))
        zero = F.lit(0).cast(totals_of[name].dataType)
        return F.aggregate(lower, zero, lambda a, t: a + F.coalesce(t[name], zero)) + F.coalesce(F.sum(of).over(within), zero)

    return rows.withColumns({name: before(name, of) for name, of in sums.items()}).drop("_range", "_totals")
