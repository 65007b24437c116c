"""What makes pages slow: vitals against their thresholds, opportunities, and what a page's markup shows by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources import html


def rated(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """df with rating (good, needs work, poor) and good_below; rows of other metrics go. A join with a dimension of six rows."""
    dim = F.array(*(F.struct(F.lit(k).alias("_metric"), F.lit(g).alias("good_below"), F.lit(p).alias("_poor")) for k, (g, p, _) in L.VITALS.items()))
    rows = df.join(F.broadcast(df.sparkSession.range(1).select(F.inline(dim))), F.col(metric) == F.col("_metric"))
    v = F.col(value)
    return rows.withColumn("rating", F.when(v <= F.col("good_below"), "good").when(v <= F.col("_poor"), "needs work").otherwise("poor")).drop("_metric", "_poor")


def opportunities(df: DataFrame, by: str, saving: str = "saving_ms", least: float = 100, most: int = 8) -> DataFrame:
    """The first of each group's opportunities (by, id, saving): those that save over `least` milliseconds."""
    order = Window.partitionBy(by).orderBy(F.desc(saving), "id")
    return df.filter(F.col(saving) > least).withColumn("k", F.row_number().over(order).cast("long")).filter(F.col("k") <= most)


def basics(pages: DataFrame, key: str, url: str = "url", text: str = "html") -> DataFrame:
    """key, check, status: HTTPS, size, viewport, blocking scripts; compression and caching if headers were kept (encoding, cache_control)."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(t)
    scripts = F.filter(html.tags(t, "script"), lambda s: (html.attribute(s, "src") != "") & ~F.rlike(s, F.lit(r"(?i)[ \t\r\n](async|defer)|type[ ]*=[ ]*[\"']module")))
    viewport = F.exists(html.tags(t, "meta"), lambda m: F.lower(html.attribute(m, "name")) == "viewport")
    checks = {
        "https": F.when(F.startswith(F.lower(url), F.lit("https://")), "pass").otherwise("fail"),
        "html_size": F.when(size > 250_000, "warn").otherwise("pass"),
        "viewport": F.when(viewport, "pass").otherwise("fail"),
        "render_blocking": F.when(F.size(scripts) > 2, "warn").otherwise("pass"),
    }
    if "encoding" in pages.columns:
        checks["compression"] = F.when(F.lower(F.coalesce("encoding", F.lit(""))).isin("gzip", "br", "zstd", "deflate"), "pass").otherwise("fail")
    if "cache_control" in pages.columns:
        control = F.coalesce("cache_control", F.lit(""))
        checks["cache"] = F.when((control == "") | F.contains(control, F.lit("no-store")), "warn").otherwise("pass")
    found = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()))
    return pages.select(key, F.explode(found).alias("_c")).select(key, "_c.*")
