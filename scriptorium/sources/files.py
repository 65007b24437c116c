"""Files as tables: pages and posts read whole, labelled text folders, trackers; and the sinks for findings and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tracker, in order. Fixed values.
TRACKER = ["date", "source", "slug", "lang", "status", "ai_pct", "fidelity", "grammar", "human_likeness", "aeo", "passes", "words", "doc_url", "notes"]
MARK = "﻿"


def kind_of(path: Column, text: Column) -> Column:
    """html by its suffix or by what the first 200 characters hold, else markdown."""
    return F.when(F.rlike(F.lower(path), F.lit(r"\.html?$")) | F.rlike(F.lower(F.substring(text, 1, 200)), F.lit(r"<!doctype html|<html|<body|<article")), "html").otherwise("markdown")


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, text, kind of each file below path; a file is a row."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("kind", kind_of(F.col("path"), F.col("text")))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """label, name, text of path/<label>/<name>.txt, without lines that start with "#"."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("_p", F.input_file_name())
    text = F.array_join(F.filter(F.split("value", "\n"), lambda x: ~F.startswith(x, F.lit("#"))), "\n")
    return rows.select(F.regexp_extract("_p", "([^/]+)/[^/]+$", 1).alias("label"), F.regexp_extract("_p", r"([^/]+)\.txt$", 1).alias("name"), text.alias("text"))


def tracker(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """The tracker's rows, latest first; numbers that aren't any are null, blank rows go."""
    rows = spark.read.option("header", "true").csv(path).toDF(*TRACKER).filter("coalesce(source, '') != ''")
    numbers = {c: F.expr(f"try_cast({c} as double)") for c in ("ai_pct", "fidelity", "grammar", "human_likeness", "aeo", "passes", "words")}
    return rows.withColumns(numbers).orderBy(F.desc("date"), "source", "lang").limit(most)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """With a header and a byte-order mark; for tables that people open."""
    head = [F.col(c).cast("string").alias(c if i else MARK + c) for i, c in enumerate(columns)]
    rows.select(*head).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_articles(rows: DataFrame, path: str) -> None:
    """One JSON line an article, a folder for each slug and language."""
    rows.write.mode("overwrite").partitionBy("slug", "lang").json(path)


#: Effort of a fix by check; others count as medium. Fixed values.
EFFORT = {"length": 1, "present": 1, "case": 1, "alt": 1, "schema": 2, "structure": 2, "readability": 3}


def prioritise(findings: DataFrame, key: str, most: int = 20) -> DataFrame:
    """What to do first: failures before warnings, high impact before low, little effort before much."""
    rank = F.when(F.col("status") == "fail", 0).otherwise(1)
    impact = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    effort = F.coalesce(F.create_map(*(F.lit(x) for kv in EFFORT.items() for x in kv))[F.col("check")], F.lit(2))
    return findings.filter("status != 'pass'").orderBy(rank, impact, effort, key, "group", "check").limit(most)


def report(findings: DataFrame, title: str, key: str, most: int = 10_000) -> str:
    """A page of the first actions, escaped. Rows so many at most are collected: a report is for reading."""
    from html import escape

    rows = prioritise(findings, key, most).collect()
    lines = "".join(f"<tr class={escape(r.status)}><td>{escape(str(r[key]))}</td><td>{escape(r.group)}</td><td>{escape(r.check)}</td><td>{escape(r.impact)}</td></tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{lines}</table></body></html>"
