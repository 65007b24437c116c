"""What needs more than one page or document: duplicates, defects, the link graph, totals, calibration, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .ranks import running


def duplicates(pages: DataFrame, values: dict[str, Column], url: str = "url") -> DataFrame:
    """what, value, n, first_url: values that several pages share, one pass for all kinds; null and empty ones count for none.

    Counts, not lists, so that a value all pages share is one row.
    """
    each = F.array(*(F.struct(F.lit(k).alias("what"), F.nullif(v, F.lit("")).alias("value")) for k, v in values.items()))
    rows = pages.select(F.col(url).alias("_url"), F.explode(each).alias("_v")).select("_url", "_v.*").filter("value is not null")
    return rows.groupBy("what", "value").agg(F.count("*").alias("n"), F.min("_url").alias("first_url")).filter("n > 1")


def defects(pages: DataFrame) -> DataFrame:
    """kind, severity, n: how many page rows have each defect; one pass, kinds unpivoted after the count."""
    title, description = F.length("title"), F.length("description")
    found = {
        ("missing_title", "fail"): F.col("title") == "",
        ("title_length", "warn"): (F.col("title") != "") & ~title.between(L.TITLE_MIN, L.TITLE_MAX),
        ("missing_meta", "fail"): F.col("description") == "",
        ("meta_length", "warn"): (F.col("description") != "") & ~description.between(L.DESCRIPTION_MIN, L.DESCRIPTION_MAX),
        ("thin", "warn"): (F.col("words") > 0) & (F.col("words") < L.THIN_WORDS),
        ("no_h1", "warn"): F.size("h1") == 0,
        ("multi_h1", "warn"): F.size("h1") > 1,
        ("no_schema", "warn"): F.size("schema_types") == 0,
        ("images_no_alt", "warn"): F.col("images_no_alt") > 0,
        ("noindex", "fail"): F.contains("robots", F.lit("noindex")),
        ("canonical_conflict", "fail"): (F.col("canonical") != "") & (F.rtrim("canonical", F.lit("/")) != F.rtrim("url", F.lit("/"))),
    }
    counts = pages.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for (k, _), c in found.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.col(k).alias("n")) for k, s in found))
    return counts.select(F.explode(rows).alias("_r")).select("_r.*").filter("n > 0")


def link_rows(pages: DataFrame, links: str = "links") -> DataFrame:
    """url, target, internal: all distinct links of each address, made absolute, no fragments, no trailing slash.

    Pages that were stored under one address are one: a link that several of them have counts once.
    """
    from ..sources.html import NO_PAGE, absolute, host

    found = F.transform(F.filter(links, lambda x: ~F.rlike(x, F.lit(NO_PAGE))), lambda x: F.rtrim(absolute(x, F.col("url")), F.lit("/")))
    rows = pages.select("url", F.explode(F.array_distinct(F.filter(found, lambda x: F.startswith(x, F.lit("http"))))).alias("target")).distinct()
    return rows.withColumn("internal", host(F.col("url")) == host(F.col("target")))


def in_degree(links: DataFrame, known: DataFrame) -> DataFrame:
    """target, n of the internal links to known pages (column url)."""
    rows = links.filter("internal").groupBy("target").agg(F.count("*").alias("n"))
    return rows.join(known.select(F.rtrim("url", F.lit("/")).alias("target")).distinct(), "target", "left_semi")


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The element at n // 2 of the sorted values, from a histogram whose counts are summed by ranges; null of an empty table."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_total"))
    rows = running(counts, value, {"_below": "_n"}).crossJoin(F.broadcast(total))
    return rows.filter("_below + _n > floor(_total / 2)").agg(F.min(value).alias("median"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """auc, n_pos, n_neg: chance that a positive scores above a negative, ties half, by rank sums over a histogram of scores."""
    counts = df.groupBy(score).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(1)).alias("q"))
    rows = running(counts, score, {"_below": "q"})
    sums = rows.agg(F.sum(F.col("p") * (2 * F.col("_below") + F.col("q"))).alias("_wins"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return sums.select(T.rounded(F.col("_wins") / (2.0 * F.col("n_pos") * F.col("n_neg")), 6).alias("auc"), "n_pos", "n_neg")


def separation(df: DataFrame, features: list[str], positive: Column) -> DataFrame:
    """feature, mean_pos, mean_neg, sep, d: class means, the gap relative to the positives', Cohen's d with pooled sample variance."""
    rows = df.withColumn("_pos", positive).select("_pos", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("_f")).select("_pos", "_f.*")
    p, q = F.when(F.col("_pos"), F.col("v")), F.when(~F.col("_pos"), F.col("v"))
    agg = rows.groupBy("feature").agg(F.avg(p).alias("mp"), F.avg(q).alias("mq"), F.var_samp(p).alias("vp"), F.var_samp(q).alias("vq"), F.count(p).alias("np"), F.count(q).alias("nq"))
    pooled = F.sqrt(((F.col("np") - 1) * F.col("vp") + (F.col("nq") - 1) * F.col("vq")) / (F.col("np") + F.col("nq") - 2))
    gap = F.col("mp") - F.col("mq")
    return agg.select("feature", T.rounded("mp", 5).alias("mean_pos"), T.rounded("mq", 5).alias("mean_neg"), T.rounded(gap / F.greatest(F.abs("mp"), F.lit(1e-6)), 5).alias("sep"), F.when(pooled > 0, T.rounded(gap / pooled, 5)).alias("d"))


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the highest seq of each key; aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def throttled(df: DataFrame, by: str, at: str, seconds: int, attempts: int, reset: Column | None = None) -> DataFrame:
    """Each failure with how many stand in the trailing window, and whether that locks out.

    With reset, rows for which it holds are successes: they clear what came before them or at their instant. Rows for which
    it is null are successes, too, and rows without a time go.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    since = []
    if reset is not None:
        df = df.withColumn("_reset", F.coalesce(reset, F.lit(True))).filter(micros.isNotNull())
        cleared = Window.partitionBy(by).orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_since", F.coalesce(F.sum(F.col("_reset").cast("int")).over(cleared), F.lit(0))).filter("not _reset")
        since = ["_since"]
    window = Window.partitionBy(by, *since).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    rows = df.withColumn("recent", F.count("*").over(window)).withColumn("locked", F.col("recent") >= attempts)
    return rows.drop("_reset", "_since")


def fresh(df: DataFrame, at: str, now: DataFrame, seconds: int) -> DataFrame:
    """The entries of a cache written within so many seconds before `now`, a table of one row (_now)."""
    rows = df.join(F.broadcast(now), F.col(at) <= F.col("_now"))
    return rows.filter(F.col(at) > F.col("_now") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).drop("_now")
