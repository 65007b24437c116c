"""Fixing a text: a writer's candidates pass a safety gate, then a gate of scores, then may be made less uniform.

A fix is not a translation: a number it takes away is shown for review, one it brings blocks it. Everything about a row is in
the row, so that a round is a projection: one scan, no join and no shuffle, whatever the writer does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import findings, integrity, scoring
from .rewriting import Provider, named, provided

#: (rows, text to rewrite or null, what blocked the last attempt, name of the new text) to rows with that column.
Writer = Callable[[DataFrame, str, str, str], DataFrame]


def _none() -> Column:
    return F.array().cast("array<string>")


def by(provider: Provider) -> Writer:
    """A provider as a writer: the violations stand below the text that it is asked to rewrite, each on a line."""

    def write(rows: DataFrame, text: str, told: str, name: str) -> DataFrame:
        lines = F.array_join(F.transform(told, lambda v: F.concat(F.lit("- "), v)), "\n")
        asked = F.when(F.size(told) > 0, F.concat_ws("\n", F.col(text), lines)).otherwise(F.col(text))
        return provided(rows.withColumn("_prompt", F.when(F.col(text).isNotNull(), asked)), provider, "_prompt", name).drop("_prompt")

    return write


def safety(df: DataFrame, before: str, after: str) -> DataFrame:
    """df with _blocking (invented numbers, lost names, stronger claims, a lost hedge) and _review (numbers taken away)."""
    rows = integrity.guard(integrity.number_diff(df, before, after), before, after)
    lost = F.when(F.col("hedge_lost"), F.array(F.lit("hedge_lost"))).otherwise(_none())
    rows = rows.withColumns({"_blocking": F.concat(named("invented"), named("missing_terms"), named("new_claims"), lost), "_review": named("dropped")})
    return rows.drop("invented", "dropped", "missing_terms", "new_claims", "hedge_lost")


def scored(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the audit's score of a text."""
    return findings.with_content(df, text, "_fs").withColumn(name, findings.score_of(F.col("_fs"))).drop("_fs")


def likened(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the detector's answer on a text: a struct of ai (likeness) and passed (all parameters do)."""
    rows = scoring.detect(df.select(F.struct("*").alias("_all"), F.col(text).alias("_said")), "_said")
    return rows.select("_all.*", F.struct(F.col("ai_likeness").alias("ai"), F.col("all_passed").alias("passed")).alias(name))


def fix(df: DataFrame, writer: Writer, humaniser: Writer | None = None, text: str = "text", tries: int = 2) -> DataFrame:
    """df with fixed, applied, reason, tried, before, after, ai_likeness, humanised, blocking, review.

    A writer is asked up to `tries` times, told what blocked its last candidate; the first safe one stands if its score is above
    the text's. One whose detector parameters don't all pass may be humanised once, which is kept if it is safe against the
    candidate, no likelier and scores no less. fixed is the text itself unless applied; reason is then safety (blocking says
    why), no_improvement or, where the writer gave nothing, pending. after and review are of the safe candidate, ai_likeness of
    what was applied; null where there is none. A null text counts as empty and is never asked for: it is pending.
    df's own columns of these names go; rows need no key and repeated ones stay.
    """
    answers = ("fixed", "applied", "reason", "tried", "before", "after", "ai_likeness", "humanised", "blocking", "review")
    rows = df.drop(*(c for c in answers if c != text))
    rows = scored(rows, text, "before").withColumns({"_fix": F.lit(None).cast("string"), "review": F.lit(None).cast("array<string>"), "blocking": _none(), "tried": F.lit(0), "_open": F.col(text).isNotNull()})
    for _ in range(tries):
        rows = writer(rows.withColumn("_ask", F.when(F.col("_open"), F.col(text))), "_ask", "blocking", "_new")
        rows = safety(rows, text, "_new")
        given = F.col("_open") & F.col("_new").isNotNull()
        safe = given & (F.size("_blocking") == 0)
        rows = rows.withColumns(
            {
                "_fix": F.when(safe, F.col("_new")).otherwise(F.col("_fix")),
                "review": F.when(safe, F.col("_review")).otherwise(F.col("review")),
                "blocking": F.when(given, F.col("_blocking")).otherwise(F.col("blocking")),
                "tried": F.col("tried") + given.cast("int"),
                "_open": given & ~safe,
            }
        ).drop("_ask", "_new", "_blocking", "_review")
    rows = scored(rows, "_fix", "_after").withColumn("after", F.when(F.col("_fix").isNotNull(), F.col("_after"))).drop("_after")
    rows = rows.withColumn("applied", F.coalesce(F.col("after") > F.col("before"), F.lit(False)))
    rows = likened(rows, "_fix", "_ai").withColumn("humanised", F.lit(False))
    if humaniser:
        rows = _humanised(rows, humaniser)
    why = F.when(F.col("applied"), F.lit(None)).when(F.col("_fix").isNotNull(), "no_improvement").when(F.col("tried") > 0, "safety").otherwise("pending")
    rows = rows.withColumns({"fixed": F.when(F.col("applied"), F.col("_fix")).otherwise(F.col(text)), "reason": why, "ai_likeness": F.when(F.col("applied"), F.col("_ai.ai"))})
    return rows.drop("_fix", "_ai", "_open")


def _humanised(rows: DataFrame, humaniser: Writer) -> DataFrame:
    open_ = F.col("applied") & ~F.col("_ai.passed")
    rows = humaniser(rows.withColumns({"_ask": F.when(open_, F.col("_fix")), "_told": _none()}), "_ask", "_told", "_new")
    rows = likened(scored(safety(rows, "_fix", "_new"), "_new", "_score"), "_new", "_like")
    better: Column = (F.col("_like.ai") <= F.col("_ai.ai")) & (F.col("_score") >= F.col("after"))
    rows = rows.withColumn("humanised", F.coalesce(F.col("_ask").isNotNull() & F.col("_new").isNotNull() & (F.size("_blocking") == 0) & better, F.lit(False)))
    taken = {"_fix": "_new", "after": "_score", "_ai": "_like"}
    rows = rows.withColumns({to: F.when(F.col("humanised"), F.col(of)).otherwise(F.col(to)) for to, of in taken.items()})
    return rows.drop("_ask", "_told", "_new", "_blocking", "_review", "_score", "_like")
