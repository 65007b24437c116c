"""Keyword seeds from headings, question stems, ideas for posts, and enrichment that leaves unknown volumes null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

ENUMERATOR = rf"^{T.WS}*[0-9]+[.)]{T.WS}*"
WORDS = 5


def _openers() -> str:
    """Words that open a question, as a word boundary ends them that doesn't count marks as parts of words."""
    letters = [w for w in L.QUESTION_OPENERS if unicodedata.category(w[-1])[0] != "M"]
    marks = [w for w in L.QUESTION_OPENERS if w not in letters]
    return rf"(?i)^({'|'.join(letters)})([^\p{{L}}\p{{N}}_]|$)|^({'|'.join(marks)})[\p{{L}}\p{{N}}_]"


OPENERS = _openers()


def bare(word: Column) -> Column:
    return F.lower(F.trim(word, F.lit(" ,।॥?.!:;\"'()")))


def topic(heading: Column, indic: Column | bool = False, most: int = WORDS) -> Column:
    """What a heading is about: no enumerator, no noise at its ends, at most so many words, cut again to no noise.

    Indic headings have their topic in front and are cut at the end, others the other way round.
    """
    indic = indic if isinstance(indic, Column) else F.lit(indic)
    clean = F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), ENUMERATOR, ""), F.lit(" ?:।॥.!"))
    trailing, leading = F.array(*map(F.lit, L.TRAILING_NOISE)), F.array(*map(F.lit, L.LEADING_NOISE))

    def edge(xs: Column, keep) -> tuple[Column, Column]:
        places = F.filter(F.transform(xs, lambda w, i: F.when(keep(w), i + 1)), lambda p: p.isNotNull())
        return F.array_min(places), F.array_max(places)

    none = F.array().cast("array<string>")

    def front(xs: Column) -> Column:
        noise = lambda w: F.array_contains(leading, bare(w)) | (indic & F.array_contains(trailing, bare(w))) | F.rlike(F.concat(w, F.lit(" ")), F.lit(OPENERS))
        first = edge(xs, lambda w: ~noise(w))[0]
        return F.when(first.isNull(), none).otherwise(F.slice(xs, first, F.size(xs)))

    def back(xs: Column) -> Column:
        last = edge(xs, lambda w: ~F.array_contains(trailing, bare(w)))[1]
        return F.when(last.isNull(), none).otherwise(F.slice(xs, 1, last))

    def named(xs: Column, f) -> Column:
        return F.transform(F.array(xs), f)[0]

    words = named(named(T.tokens(clean), front), back)
    cut = named(words, lambda xs: F.when(F.size(xs) <= most, xs).when(indic, F.slice(xs, 1, most)).otherwise(F.slice(xs, F.greatest(F.size(xs) - most + 1, F.lit(1)), most)))
    done = named(named(cut, back), front)
    return F.trim(F.array_join(done, " "), F.lit(" ,-–—"))


def seeds(articles: DataFrame, key: str, indic: Column | bool = False, most: int = 10) -> DataFrame:
    """key, pos, term, source: topics of the title and the subheadings, each once, the first so many. articles: title, blocks."""
    heads = F.transform(F.filter("blocks", lambda b: b["type"].isin("h2", "h3")), lambda b: F.struct(b["text"].alias("text"), F.lit("heading").alias("source")))
    given = F.concat(F.array(F.struct(F.coalesce("title", F.lit("")).alias("text"), F.lit("title").alias("source"))), heads)
    rows = articles.withColumn("_indic", indic if isinstance(indic, Column) else F.lit(indic)).select(key, "_indic", F.posexplode(given).alias("pos", "_g"))
    rows = rows.select(key, "pos", T.clean(topic(F.col("_g.text"), F.col("_indic"))).alias("term"), F.col("_g.source").alias("source"))
    rows = rows.filter((F.length("term") > 2) & (F.length("term") < 60))
    once = Window.partitionBy(key, F.lower("term")).orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    k = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("pos", k.cast("long")).filter(F.col("pos") <= most).select(key, "pos", "term", "source")


def expand(found: DataFrame, key: str, lang: str, longest: int = 90) -> DataFrame:
    """key, pos, keyword, intent, source: each seed and its questions in the language, none twice, the first one stays.

    A stem whose content word the seed has already is passed over.
    """
    stems = L.QUESTION_STEMS.get(lang, [])
    glue = F.array(*map(F.lit, [*L.TRAILING_NOISE, *L.STEM_GLUE]))
    rows = found.withColumn("_own", F.transform(T.tokens(F.col("term")), bare))
    head = rows.select(key, "pos", F.lit(0).alias("_i"), F.col("term").alias("keyword"), F.lit("head").alias("intent"), "source")
    if stems:
        asked = rows.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(s).alias("stem")) for i, s in enumerate(stems)))))
        content = F.filter(F.transform(T.tokens(F.replace("_s.stem", F.lit("{}"), F.lit(""))), bare), lambda w: ~F.array_contains(glue, w))
        asked = asked.filter(~F.arrays_overlap(content, F.col("_own")))
        head = head.unionByName(asked.select(key, "pos", F.col("_s.i").alias("_i"), F.replace("_s.stem", F.lit("{}"), F.col("term")).alias("keyword"), F.lit("question").alias("intent"), "source"))
    head = head.withColumn("keyword", T.clean(F.col("keyword"))).filter((F.col("keyword") != "") & (F.length("keyword") <= longest))
    once = Window.partitionBy(key, F.lower("keyword")).orderBy("pos", "_i")
    return head.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select(key, "pos", F.col("_i").cast("long").alias("stem"), "keyword", "intent", "source")


def with_volumes(keywords: DataFrame, volumes: DataFrame) -> DataFrame:
    """keywords with volume; null where the provider has none, never an estimate."""
    known = volumes.select(F.lower("keyword").alias("_k"), "volume").dropDuplicates(["_k"])
    return keywords.withColumn("_k", F.lower("keyword")).join(known, "_k", "left").drop("_k")


def queries_of(topics: DataFrame, topic_column: str, lang: str = "en", deep: bool = False) -> DataFrame:
    """topic_column, query: what an autocomplete is asked for a topic: prefixes, suffixes and, deep, the alphabet."""
    t = F.col(topic_column)
    made = [t, *(F.concat(F.lit(f"{p} "), t) for p in L.QUERY_PREFIX.get(lang, L.QUERY_PREFIX["en"])), *(F.concat(t, F.lit(s)) for s in L.QUERY_SUFFIX.get(lang, L.QUERY_SUFFIX["en"]) if s)]
    made += [F.concat(t, F.lit(f" {c}")) for c in "abcdefghijklmnopqrstuvwxyz"] if deep else []
    return topics.select(topic_column, F.explode(F.array(*made)).alias("query"))


def suggested(asked: DataFrame, answers: DataFrame, topic_column: str) -> DataFrame:
    """topic_column, suggestion, hits, k: the answers (query, suggestion) to the queries of a topic, ranked.

    Echoes of what was asked go, and what adds no word to the topic; those that contain the topic come first, then the
    frequent, then the short. All joins are merge joins: what compresses well isn't small where it is sent whole.
    """
    rows = asked.join(answers.hint("merge"), "query").withColumn("suggestion", T.strip(F.col("suggestion"))).filter(F.length("suggestion") > 4)
    hits = rows.groupBy(topic_column, "suggestion").agg(F.count("*").alias("hits"))
    topic_low, low = F.lower(topic_column), F.lower("suggestion")
    echo = asked.select(topic_column, F.lower("query").alias("_low")).distinct()
    hits = hits.withColumn("_low", low).join(echo.withColumn("_echo", F.lit(True)).hint("merge"), [topic_column, "_low"], "left")
    new = F.size(F.array_except(T.token_set(F.col("suggestion"), L.SITE_STOP), T.token_set(F.col(topic_column), L.SITE_STOP))) > 0
    hits = hits.filter((low == topic_low) | (F.col("_echo").isNull() & new))
    order = Window.partitionBy(topic_column).orderBy(~F.contains(low, topic_low), F.desc("hits"), F.length("suggestion"), "suggestion")
    return hits.select(topic_column, "suggestion", "hits", F.row_number().over(order).cast("long").alias("k"))


def rank_suggestions(hits: DataFrame, about: str) -> DataFrame:
    """suggestion, hits: without the topic itself; those that contain it first, then the frequent, then the short."""
    rows = hits.filter(F.lower(F.trim("suggestion")) != about.lower()).groupBy(F.lower(F.trim("suggestion")).alias("suggestion")).agg(F.count("*").alias("hits"))
    return rows.orderBy(~F.contains("suggestion", F.lit(about.lower())), F.desc("hits"), F.length("suggestion"), "suggestion")


def title_options(candidates: DataFrame, by: str, of: int = 8, most: int = 5) -> DataFrame:
    """by, k, title: working titles of the first uncovered candidates (by, pos, query, status), each once, of a title's length."""
    gap = F.when(F.col("status") == "gap", 0).otherwise(1)
    first = Window.partitionBy(by).orderBy(gap, "pos")
    rows = candidates.filter("status != 'covered'").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= of)
    t = T.strip(F.col("query"))
    rows = rows.withColumn("title", F.concat(T.capital(F.substring(t, 1, 1)), F.substring(t, 2, 1000))).filter((F.length("title") > 15) & (F.length("title") < 70))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, F.lower("title")).orderBy("_k"))).filter("_n = 1")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("_k")).cast("long")).filter(F.col("k") <= most).select(by, "k", "title")


def internal_links(candidates: DataFrame, by: str, most: int = 6) -> DataFrame:
    """by, k, match, why: the posts that candidates (by, pos, query, status, match) lead to, covered ones first, each once."""
    rank = F.when(F.col("status") == "covered", 0).otherwise(1)
    rows = candidates.filter("status != 'gap' and match is not null").withColumn("_n", F.row_number().over(Window.partitionBy(by, "match").orderBy(rank, "pos"))).filter("_n = 1")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(rank, "pos")).cast("long")).filter(F.col("k") <= most)
    return rows.select(by, "k", "match", F.col("query").alias("why"))
