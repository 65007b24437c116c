"""One article against its competitors: profiles, topics and entities it lacks, and the spread of its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .findings import STATISTIC
from .similarity import frequencies, in_order, kept, leaders, meet

#: F1 of topic words from which two headings are alike.
ALIKE = 0.55
MEASURES = ["words", "faqs", "images", "links_external", "answer_blocks", "stats", "questions"]


def topic_tokens(t: Column) -> Column:
    return T.token_set(t, L.AUDIT_STOP, 3)


def profile(articles: DataFrame) -> DataFrame:
    """articles with the measures that are compared. articles: text (whole), blocks, faqs, images, links."""
    heads = F.filter("blocks", lambda b: b["type"].isin("h2", "h3"))
    found = {
        "words": T.word_count(F.col("text")),
        "faqs_n": F.size("faqs"),
        "images_n": F.size("images"),
        "links_external": F.size(F.filter("links", lambda x: F.startswith(x["href"], F.lit("http")))),
        "answer_blocks": F.size(F.filter("blocks", lambda b: b["type"] == "answer")),
        "stats": T.regex_count(F.col("text"), STATISTIC),
        "questions": F.size(F.filter(heads, lambda b: T.is_question(b["text"]))),
        "has_tldr": F.exists("blocks", lambda b: b["type"] == "tldr").cast("int"),
        "has_schema": (F.size("schema_types") > 0).cast("int"),
    }
    return articles.withColumns({k: v.cast("long") for k, v in found.items()})


def similar_pairs(headings: DataFrame, others: DataFrame, by: str) -> DataFrame:
    """a, b: headings (by, seq, heading) and others of the same group whose topic words are alike, met by a rare common word."""
    left, right = (x.select(by, "seq", topic_tokens(F.col("heading")).alias("_set")) for x in (headings, others))
    counts = frequencies(right, by=[by])
    pairs = meet(in_order(left, "seq", counts, [by]), in_order(right, "seq", counts, [by]), "seq", "seq", ALIKE, [by])
    return pairs.select("a", "b")


def topic_gaps(mine: DataFrame, theirs: DataFrame, by: str, scratch: str, least: int = 8) -> DataFrame:
    """by, seq, heading, sources, n_sources, is_question: headings of competitors with no like of one's own, like ones merged.

    mine: by, seq, heading; theirs: also url. seq orders all headings, is unique, and decides which of like ones stands for
    the others, as a greedy pass in that order would. scratch: a folder for the rounds.
    """
    open_ = kept(theirs.filter(F.length("heading") >= least), f"{scratch}/open")
    known = similar_pairs(open_, mine, by).select(F.col("a").alias("seq")).distinct()
    gaps = kept(open_.join(known, "seq", "left_anti"), f"{scratch}/gaps")
    pairs = kept(similar_pairs(gaps, gaps, by).filter("a < b"), f"{scratch}/alike")
    merged = kept(leaders(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), scratch), f"{scratch}/led")
    members = merged.select(F.col("member").alias("seq")).distinct()
    lead = gaps.join(members, "seq", "left_anti")
    joined = pairs.join(lead.select(F.col("seq").alias("a")), "a").join(members.select(F.col("seq").alias("b")), "b")
    more = joined.join(gaps.select(F.col("seq").alias("b"), "url"), "b").select(F.col("a").alias("seq"), "url")
    urls = lead.select("seq", "url").unionAll(more).groupBy("seq").agg(F.array_sort(F.collect_set("url")).alias("sources"))
    rows = lead.select(by, "seq", "heading").join(urls, "seq")
    return rows.select(by, "seq", "heading", "sources", F.size("sources").cast("long").alias("n_sources"), T.is_question(F.col("heading")).alias("is_question"))


def ranked_gaps(gaps: DataFrame, by: str, most: int = 25) -> DataFrame:
    """The first of each group's gaps: those of many sources, questions before others, then in order."""
    order = Window.partitionBy(by).orderBy(F.desc("n_sources"), F.desc("is_question"), "seq")
    return gaps.withColumn("k", F.row_number().over(order).cast("long")).filter(F.col("k") <= most)


def entity_gaps(mine: DataFrame, theirs: DataFrame, by: str, most: int = 15) -> DataFrame:
    """by, entity, n_sources, k: what competitors name (by, entity, url) and one's own article (by, entity) doesn't."""
    own = mine.select(by, F.lower("entity").alias("_e")).distinct()
    rows = theirs.withColumn("_e", F.lower("entity")).join(own, [by, "_e"], "left_anti")
    rows = rows.groupBy(by, "entity").agg(F.countDistinct("url").alias("n_sources"))
    order = Window.partitionBy(by).orderBy(F.desc("n_sources"), "entity")
    return rows.withColumn("k", F.row_number().over(order).cast("long")).filter(F.col("k") <= most)


def spreads(profiles: DataFrame, by: str, mine: Column, measures: list[str]) -> DataFrame:
    """by, measure, mine, best, median (upper), behind of each group with competitors; mine marks one's own row."""
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("v")) for m in measures))
    rows = profiles.select(by, mine.alias("_mine"), F.explode(each).alias("_m")).select(by, "_mine", "_m.*")
    own, other = F.when(F.col("_mine"), F.col("v")), F.when(~F.col("_mine"), F.col("v"))
    sums = rows.groupBy(by, "measure").agg(F.max(own).alias("mine"), F.max(other).alias("best"), F.array_sort(F.collect_list(other)).alias("_all"))
    sums = sums.filter("mine is not null and best is not null")
    return sums.select(by, "measure", "mine", "best", F.element_at("_all", (F.floor(F.size("_all") / 2) + 1).cast("int")).alias("median"), (F.col("mine") < F.col("best")).alias("behind"))


def wins(profiles: DataFrame, by: str, mine: Column) -> DataFrame:
    """by, win: what one's own article has and no competitor does."""
    own, other = (lambda c: F.max(F.when(mine, F.col(c)))), (lambda c: F.max(F.when(~mine, F.col(c))))
    kinds = ("has_tldr", "answer_blocks", "has_schema", "words")
    sums = profiles.groupBy(by).agg(*(f(k).alias(f"{side}_{k}") for k in kinds for side, f in (("own", own), ("other", other)))).filter("other_words is not null and own_words is not null")
    only = lambda k: F.when((F.col(f"own_{k}") > 0) & (F.col(f"other_{k}") == 0), F.lit(k))
    longest = F.when(F.col("own_words") >= F.col("other_words"), F.lit("words"))
    return sums.select(by, F.explode(F.array_compact(F.array(only("has_tldr"), only("answer_blocks"), only("has_schema"), longest))).alias("win"))
