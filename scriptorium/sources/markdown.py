"""Blocks from markdown, and from plain text lines, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADING, BULLET, NUMBERED, QUOTED = r"^#+[ \t]+", r"^[-*+][ \t]+", r"^[0-9]+[.)][ \t]+", r"^>[ \t]*"


def blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, type, text: the first "# " heading is the title (type h1), later and second-level ones h2, deeper ones h3.

    Lists are li, quotes quote, other lines p; blank lines go.
    """
    line = F.trim(F.col("_line"))
    rows = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_i", "_line")).withColumn("_line", line).filter("_line != ''")
    level = F.length(F.regexp_extract("_line", "^(#*)[ \t]", 1))
    rows = rows.withColumn("_level", level)
    order = Window.partitionBy(key).orderBy("_i")
    rows = rows.withColumn("_top", F.sum((F.col("_level") == 1).cast("int")).over(order))
    kind = (
        F.when((F.col("_level") == 1) & (F.col("_top") == 1), "h1")
        .when(F.col("_level").between(1, 2), "h2")
        .when(F.col("_level") > 2, "h3")
        .when(F.rlike("_line", F.lit(BULLET)) | F.rlike("_line", F.lit(NUMBERED)), "li")
        .when(F.rlike("_line", F.lit(QUOTED)), "quote")
        .otherwise("p")
    )
    plain = F.regexp_replace("_line", f"{HEADING}|{BULLET}|{NUMBERED}|{QUOTED}", "")
    return rows.select(key, (F.row_number().over(order) - 1).alias("pos"), kind.alias("type"), T.clean(plain).alias("text"))


def faqs(blocks_: DataFrame, key: str, longest: int = 700) -> DataFrame:
    """key, pos, q, a: question headings with the paragraphs and list items up to the next heading.

    The answer takes a block as long as what it has so far is at most `longest` characters.
    """
    order = Window.partitionBy(key).orderBy("pos")
    head = F.col("type").isin("h1", "h2", "h3")
    rows = blocks_.withColumn("_part", F.sum(head.cast("int")).over(order))
    part = Window.partitionBy(key, "_part").orderBy("pos")
    rows = rows.withColumns({"_q": F.first("text").over(part), "_qt": F.first("type").over(part), "_qp": F.first("pos").over(part)})
    body = rows.filter(F.col("type").isin("p", "li") & F.col("_qt").isin("h2", "h3") & T.is_question(F.col("_q")))
    taken = F.coalesce(F.sum(F.length("text") + 1).over(part.rowsBetween(Window.unboundedPreceding, -1)) - 1, F.lit(0))
    body = body.withColumn("_before", taken).filter(F.col("_before") <= longest)
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return body.groupBy(key, F.col("_qp").alias("pos"), F.col("_q").alias("q")).agg(answer.alias("a"))


def title_of(blocks_: DataFrame, key: str) -> DataFrame:
    return blocks_.filter("type = 'h1'").groupBy(key).agg(F.min_by("text", "pos").alias("title"))


def to_markdown(blocks_: DataFrame, key: str) -> DataFrame:
    """key, markdown: the blocks written out in order."""
    mark: Column = F.when(F.col("type") == "h1", "# ").when(F.col("type") == "h2", "## ").when(F.col("type") == "h3", "### ").when(F.col("type") == "li", "- ").when(F.col("type") == "quote", "> ").otherwise("")
    line = F.struct("pos", F.concat(mark, "text").alias("line"))
    return blocks_.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n\n").alias("markdown"))
