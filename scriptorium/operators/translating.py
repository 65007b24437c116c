"""Translation of articles by external engines: every visible string apart, in order, batched, and put back together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import integrity
from .rewriting import Provider, cached

#: A token that machine translators copy.
TOKEN = "zq{}qz"


def strings(articles: DataFrame, key: str) -> DataFrame:
    """key, pos, field, at, text: the title, the description, the blocks, the alternative texts, questions and answers."""
    def each(column: str, field: str, name: str) -> Column:
        return F.transform(column, lambda x, i: F.struct(F.lit(field).alias("field"), i.cast("int").alias("at"), F.coalesce(x[name], F.lit("")).alias("text")))

    def one(field: str) -> Column:
        return F.array(F.struct(F.lit(field).alias("field"), F.lit(0).alias("at"), F.coalesce(field, F.lit("")).alias("text")))

    every = F.concat(one("title"), one("meta_description"), each("blocks", "block", "text"), each("images", "alt", "alt"), each("faqs", "q", "q"), each("faqs", "a", "a"))
    return articles.select(key, F.posexplode(every).alias("pos", "_s")).select(key, F.col("pos").cast("long").alias("pos"), "_s.*")


def reassembled(articles: DataFrame, translated: DataFrame, key: str) -> DataFrame:
    """articles with the texts of translated (key, field, at, text) in the places they came from."""
    packed = translated.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("#", "field", "at"), "text"))).alias("_new"))
    rows = articles.join(packed, key, "left")

    def new(field: str, i: Column, old: Column) -> Column:
        return F.coalesce(F.try_element_at("_new", F.concat(F.lit(f"{field}#"), i.cast("string"))), old)

    zero = F.lit(0)
    return rows.withColumns(
        {
            "title": new("title", zero, F.col("title")),
            "meta_description": new("meta_description", zero, F.col("meta_description")),
            "blocks": F.transform("blocks", lambda b, i: F.struct(b["type"].alias("type"), new("block", i, b["text"]).alias("text"))),
            "images": F.transform("images", lambda x, i: F.struct(x["src"].alias("src"), new("alt", i, x["alt"]).alias("alt"))),
            "faqs": F.transform("faqs", lambda x, i: F.struct(new("q", i, x["q"]).alias("q"), new("a", i, x["a"]).alias("a"))),
        }
    ).drop("_new")


def batches(rows: DataFrame, by: str, size: int = 3600) -> DataFrame:
    """rows (by, pos, text) with batch: greedily filled in order, none over `size` characters unless a single text is.

    One pass over a document's strings, as a batch's start depends on all before it.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x["text"])
        fresh = (acc["used"] > 0) & (acc["used"] + n > size)
        at = acc["n"] + fresh.cast("int")
        return F.struct(at.alias("n"), F.when(fresh, n).otherwise(acc["used"] + n).alias("used"), F.concat(acc["out"], F.array(at)).alias("out"))

    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    packed = rows.groupBy(by).agg(ordered.alias("_x")).withColumn("_b", F.aggregate("_x", start, step, lambda a: a["out"]))
    return packed.select(by, F.explode(F.arrays_zip("_x", "_b")).alias("_z")).select(by, F.col("_z._x.pos").alias("pos"), F.col("_z._x.text").alias("text"), F.col("_z._b").alias("batch"))


def translate_articles(articles: DataFrame, key: str, provider: Provider, cache: DataFrame, limit: int = 900) -> DataFrame:
    """articles translated: strings are cut into chunks of sentences, addresses masked, equal chunks asked for once.

    cache: key, value. What the provider doesn't give keeps its source. Digits come back as ASCII's.
    """
    parts = strings(articles, key).filter("text != ''").select(key, "field", "at", F.posexplode(T.chunk_sentences(F.col("text"), limit)).alias("_i", "_chunk"))
    parts = cached(integrity.masked(parts, "_chunk", TOKEN, integrity.UNWORDED), cache, provider, "masked", "_got")
    parts = integrity.unmasked(parts.withColumn("_got", F.coalesce("_got", "masked")), "_got", "held", TOKEN)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "unmasked"))), lambda x: x["unmasked"]), " ")
    whole = parts.groupBy(key, "field", "at").agg(T.ascii_digits(T.strip(joined)).alias("text"))
    return reassembled(articles, whole, key)


def chain(providers: list[Callable[[Iterator[str]], Iterator[str | None]]], attempts: int = 2) -> Provider:
    """A provider that asks one after the other for what those before it didn't give; one that fails is asked so often."""
    def ask(texts: Iterator[str]) -> Iterator[str | None]:
        given = list(texts)
        found: list[str | None] = [None] * len(given)
        for provider in providers:
            open_ = [i for i, x in enumerate(found) if x is None]
            for _ in range(attempts):
                if not open_:
                    break
                try:
                    for i, x in zip(open_, list(provider(iter([given[i] for i in open_]))), strict=True):
                        found[i] = x
                    break
                except Exception:  # noqa: BLE001, S112  an external engine may fail in any way; the next one is asked
                    continue
        return iter(found)

    return ask
