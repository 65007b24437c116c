"""Pages from the web as rows: fetching with retries, errors as data, and crawls that go on where they stopped.

What fetches is a function from an address to a Response; http() is one, tests bring their own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import files, html, site_files

FETCHED = "url string, status int, final_url string, redirects int, html string, error string"
#: Where a site's map is looked for if its robots.txt names none. Fixed values.
MAPS = ["/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap-index.xml"]


@dataclass
class Response:
    status: int
    url: str
    body: bytes
    kind: str = "text/html"
    charset: str | None = None
    redirects: int = 0


Fetch = Callable[[str], Response]


def decoded(response: Response) -> str:
    """Latin-1 is what servers say that don't know: then UTF-8 is tried first."""
    charset = response.charset or ""
    if charset.lower() in ("", "iso-8859-1"):
        try:
            return response.body.decode("utf-8")
        except UnicodeDecodeError:
            return response.body.decode("latin-1")
    return response.body.decode(charset, "replace")


def http(url: str, timeout: int = 30) -> Response:
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
            return Response(r.status, r.geturl(), r.read(), r.headers.get_content_type(), r.headers.get_content_charset(), int(r.geturl() != url))
    except urllib.error.HTTPError as e:
        return Response(e.code, url, b"", e.headers.get_content_type() if e.headers else "")


def retried(fetch: Fetch, attempts: int = 3, wait: float = 1.0) -> Fetch:
    """Asks again after 1, 2, 4 times the wait."""
    def ask(url: str) -> Response:
        for i in range(attempts):
            try:
                return fetch(url)
            except Exception:  # noqa: BLE001  a network may fail in any way
                if i + 1 == attempts:
                    raise
                time.sleep(wait * 2**i)
        raise ValueError("no attempts")

    return ask


def fetched(urls: DataFrame, fetch: Fetch, workers: int = 2, pause: float = 1.0) -> DataFrame:
    """FETCHED of the urls (url): an error, a status of 400 or more and what is no HTML are rows without html; none ends the
    job. `workers` partitions, each of which waits `pause` seconds between two requests, bound the rate."""
    def rows(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, url in enumerate(batch.column(0).to_pylist()):
                if i and pause:
                    time.sleep(pause)
                try:
                    r = fetch(url)
                    good = r.status < 400
                    error = f"not html ({r.kind[:40]})" if good and "html" not in r.kind else None
                    out.append((url, r.status, r.url, r.redirects, decoded(r) if good and not error else None, error))
                except Exception as e:  # noqa: BLE001
                    out.append((url, 0, None, 0, None, f"{type(e).__name__}: {e}"[:160]))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in FETCHED.split(", ")])

    return urls.select("url").repartition(workers).mapInArrow(rows, FETCHED)


def discover(site: str, fetch: Fetch) -> str | None:
    """The address of a site's map: what robots.txt names, else the first usual place that has one."""
    base = site.rstrip("/") if "//" in site else f"https://{site.rstrip('/')}"

    def text(path: str) -> str:
        try:
            r = fetch(base + path)
            return decoded(r) if r.status < 400 else ""
        except Exception:  # noqa: BLE001
            return ""

    for line in text("/robots.txt").splitlines():
        name, _, value = line.partition(":")
        if name.strip().lower() == "sitemap" and value.strip():
            return value.strip()
    return next((base + p for p in MAPS if "<urlset" in (t := text(p)) or "<sitemapindex" in t), None)


def site_urls(spark: SparkSession, start: str, fetch: Fetch, contains: str = "", limit: int = 0, most: int = 25) -> DataFrame:
    """url: the pages of a site's maps, each once, that hold `contains`. Maps are few and fetched by the driver."""
    maps, queue, pages = {}, [start], {}
    while queue and len(maps) < most:
        url = queue.pop(0)
        if url in maps:
            continue
        try:
            maps[url] = decoded(fetch(url))
        except Exception:  # noqa: BLE001
            maps[url] = ""
            continue
        row = spark.range(1).select(site_files.sitemap_urls(F.lit(maps[url])).alias("u"), site_files.is_index(F.lit(maps[url])).alias("i")).first()
        if row.i:
            queue += row.u
        else:
            pages |= dict.fromkeys(u for u in row.u if contains in u and not u.lower().split("?")[0].endswith(site_files.NO_PAGE))
        if limit and len(pages) >= limit:
            break
    found = list(pages)[: limit or None]
    return spark.createDataFrame([(u,) for u in found], "url string")


def store(spark: SparkSession, path: str) -> DataFrame | None:
    """What a crawl has stored, the last row of each address; torn lines are skipped. None before the first one."""
    try:
        rows = spark.read.schema(FETCHED + ", seq long").option("mode", "DROPMALFORMED").json(path).filter("url is not null")
    except AnalysisException:
        return None
    from ..operators.corpus import last_wins

    return last_wins(rows, "url", "seq")


def crawl(spark: SparkSession, urls: DataFrame, path: str, fetch: Fetch, robots: str = "", workers: int = 2, pause: float = 1.0, refresh: bool = False) -> DataFrame:
    """The pages of urls as stored rows: those that aren't stored yet, and that robots.txt lets in, are fetched and appended.

    A crawl that is stopped goes on with what is missing. refresh fetches all again; later rows win.
    """
    known = None if refresh else store(spark, path)
    rules = site_files.robots_rules(spark.createDataFrame([(0, robots)], "id int, robots string"), "id")
    asked = urls.withColumn("path", F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")))
    asked = site_files.robots_allowed(asked, rules).select("url")
    if known is not None:
        asked = asked.join(known.select("url"), "url", "left_anti")
    turn = time.time_ns() // 1000
    fetched(asked, fetch, workers, pause).withColumn("seq", F.lit(turn)).write.mode("append").json(path)
    return store(spark, path)


def pages(stored: DataFrame) -> DataFrame:
    """Page rows of what was stored; rows without HTML keep their status and error."""
    rows = html.page_rows(stored.withColumn("_url", F.coalesce("final_url", "url")).withColumnRenamed("url", "asked").withColumnRenamed("_url", "url"))
    return rows


def load(spark: SparkSession, fetch: Fetch, file: str | None = None, urls: list[str] | None = None, sitemap: str | None = None, **how) -> DataFrame:
    """path, text, kind, error of exactly one of a file or folder, addresses, or a site's map. What can't be read is a row
    with an error and no text."""
    if sum(x is not None for x in (file, urls, sitemap)) != 1:
        raise ValueError("name one of file, urls and sitemap")
    if file is not None:
        return files.load(spark, file).withColumn("error", F.lit(None).cast("string"))
    wanted = spark.createDataFrame([(u,) for u in urls], "url string") if urls is not None else site_urls(spark, sitemap, fetch, how.pop("contains", ""), how.pop("limit", 0))
    rows = fetched(wanted, fetch, **how)
    return rows.select(F.col("url").alias("path"), F.col("html").alias("text"), F.lit("html").alias("kind"), F.coalesce("error", F.when(F.col("status") >= 400, F.concat(F.lit("status "), "status"))).alias("error"))
