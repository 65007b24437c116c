"""The bounded rewrite loop over external writers, and the providers' interface.

Writers are external: a provider maps a partition of texts to texts and yields None where it has nothing. Values it doesn't
give stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import integrity

Provider = Callable[[Iterator[str]], Iterator[str | None]]


def provided(df: DataFrame, provider: Provider, text: str, name: str) -> DataFrame:
    """df with what the provider makes of each text: one call a partition, batch by batch."""

    @F.pandas_udf("string")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(list(provider(iter(texts))), dtype=object)

    return df.withColumn(name, call(text))


def cached(df: DataFrame, cache: DataFrame, provider: Provider, text: str, name: str) -> DataFrame:
    """The same, asking only for texts that the cache (key, value; key: SHA-256) hasn't; equal texts are asked for once."""
    keyed = df.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    missing = keyed.select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"]).join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    fresh = provided(missing, provider, "_text", "value").select("_key", "value")
    known = cache.select(F.col("key").alias("_key"), "value").unionAll(fresh)
    return keyed.join(known, "_key", "left").withColumn(name, F.col("value")).drop("_key", "value")


def defects(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with _defects: the blocking signatures of target against source."""
    rows = integrity.guard(integrity.number_diff(df, source, target), source, target)
    parts = [named("invented"), named("dropped"), named("missing_terms"), named("new_claims"), F.when(F.col("hedge_lost"), F.array(F.lit("hedge_lost"))).otherwise(F.array().cast("array<string>"))]
    return rows.withColumn("_defects", F.array_distinct(F.flatten(F.array(*parts)))).drop("invented", "dropped", "missing_terms", "new_claims", "hedge_lost")


def named(column: str):
    return F.transform(column, lambda v: F.concat(F.lit(f"{column}:"), v))


def repair(df: DataFrame, provider: Provider, source: str, target: str, passes: int = 3) -> DataFrame:
    """df with target repaired, passes (rewrites asked for) and status (scored or needs_human_review).

    Texts without a blocking defect are never rewritten. A rewrite is taken if it brings no new defect and removes one; one
    that isn't taken ends the attempts on its text. `passes` bounds the rounds, each of which asks only for open texts.
    """
    rows = defects(df, source, target).withColumns({"passes": F.lit(0), "_open": F.size("_defects") > 0})
    for _ in range(passes):
        asked = provided(rows.filter("_open").drop("_new"), provider, target, "_new")
        after = defects(asked.withColumnRenamed("_defects", "_old"), source, "_new")
        taken = (F.size(F.array_except("_defects", "_old")) == 0) & (F.size("_defects") < F.size("_old")) & F.col("_new").isNotNull()
        after = after.withColumns({"_ok": taken, "passes": F.col("passes") + 1})
        after = after.withColumns({target: F.when(F.col("_ok"), F.col("_new")).otherwise(F.col(target)), "_defects": F.when(F.col("_ok"), F.col("_defects")).otherwise(F.col("_old"))})
        after = after.withColumn("_open", F.col("_ok") & (F.size("_defects") > 0)).drop("_new", "_old", "_ok")
        rows = rows.filter("not _open").unionByName(after)
    return rows.withColumn("status", F.when(F.size("_defects") == 0, "scored").otherwise("needs_human_review")).drop("_open", "_defects")
