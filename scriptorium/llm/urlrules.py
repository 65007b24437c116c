"""URL filters: allow and block rules on host suffixes and path prefixes.

Each URL is expanded into its host suffixes (at dots) times its path prefixes (of the lengths that rules have). The
expressions meet the rules in an equi-join on the first four bytes of their SHA-256 digests alone; of what meets, the full
digests confirm, and the longest rule wins.

Defined results: a null URL or one without "://" has an empty host and path and no rule. Of rules of one length the one with
the longer host wins; of equal rules with both verdicts, block. Rows equal in id and URL are judged once and returned as
often as they stand in the input. An empty table gives an empty result; columns but the id and the URL aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules so many at most are broadcast (some 10 MB); more are joined by a shuffle, whose hot keys AQE splits.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (host, path, allow or block), as literals. Long lists are better read from a table."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows.cast("array<struct<host: string, path: string, verdict: string>>")))


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """The id, host, path, rule (null where none fits) and verdict of every row. rules: host, path, verdict."""
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("_host"), F.col("path").alias("_path")).agg(F.max("verdict").alias("_verdict"))
    rules = rules.withColumn("rule", F.concat("_host", "_path")).withColumn("_full", F.sha2("rule", 256)).withColumn("_short", _prefix(F.col("_full")))
    found = rules.agg(F.count("*"), F.sort_array(F.collect_set(F.length("_path")))).first()
    lengths = found[1]  # as many as rules' paths have lengths
    if found[0] <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    url = F.col(f"`{url_column}`")
    base = urls.select(F.col(f"`{id_column}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).groupBy("id", "host", "path").agg(F.count("*").alias("_rows"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    paths = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    rows = base.withColumn("_expression", F.explode_outer(expressions))
    rows = rows.withColumn("_digest", F.sha2("_expression", 256)).withColumn("_at", _prefix(F.col("_digest")))
    met = rows.join(rules, F.col("_at") == F.col("_short"), "left")
    best = F.max(F.when(F.col("_digest") == F.col("_full"), F.struct(F.length("rule").alias("n"), F.length("_host").alias("h"), "rule", "_verdict")))
    judged = met.groupBy("id", "host", "path", "_rows").agg(best.alias("_best"))
    judged = judged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))
