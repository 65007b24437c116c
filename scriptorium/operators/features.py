"""Per-document measurements: narrow projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T


def openers(sents: Column) -> Column:
    """Of each sentence of more than three words the first two, in lower case. Sentences have no white space around them."""
    starts = F.transform(sents, lambda s: F.split(s, f"{T.WS}+", 4))  # three words and the rest
    return F.transform(F.filter(starts, lambda w: F.size(w) > 3), lambda w: F.lower(F.concat(w[0], F.lit(" "), w[1])))


def repeated(found: Column, times: int = 3) -> Column:
    """How many of the values stand so often or more: run lengths of the sorted ones, in one pass."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        more = F.when(run == times, times).when(run > times, 1).otherwise(0)
        return F.struct(x.alias("last"), run.alias("run"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["n"])


def english(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of df and the English measurements, each rounded as it is reported. Sentences and words are parted once."""
    t = F.col("_t")
    rows = df.withColumn("_t", T.strip(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumns({"_low": F.lower(t), "_sents": T.sentences(t), "words": F.greatest(T.word_count(t), F.lit(1)).cast("long")})
    rows = rows.withColumns({"_lens": F.filter(F.transform("_sents", T.word_count), lambda n: n > 1), "_paras": F.filter(F.transform(F.split(t, "\n"), T.word_count), lambda n: n > 3), "_openers": openers(F.col("_sents")), "_toks": T.tokens(F.col("_low"))})
    rows = rows.withColumns({"_again": repeated(F.col("_openers")), "_kinds": F.size(F.array_distinct("_toks"))})
    words, lens, n = F.col("words"), F.col("_lens"), F.size("_sents")
    total = F.aggregate(lens, F.lit(0), lambda a, x: a + x)
    return rows.withColumns(
        {
            "n_sents": n.cast("long"),
            "mean_len": F.when(F.size(lens) > 0, T.rounded(total / F.size(lens), 1)).otherwise(0.0),
            "sent_cv": F.when(F.size(lens) > 2, T.rounded(T.variation(lens), 3)).otherwise(0.0),
            "para_cv": F.when(F.size("_paras") > 3, T.rounded(T.variation(F.col("_paras")), 3)).otherwise(0.0),
            "rep_open": F.when(F.size("_openers") == 0, 0.0).otherwise(T.rounded(F.col("_again") / F.size("_openers"), 3)),
            "filler_1k": T.per_thousand(T.phrase_count(F.col("_low"), L.FILLER), words),
            "tell_1k": T.per_thousand(T.phrase_count(F.col("_low"), L.TELLS), words),
            "em_dash_1k": T.per_thousand(T.phrase_count(t, ["—", " - "]), words),
            "passive_ratio": F.when(n > 0, T.rounded(T.regex_count(t, T.PASSIVE) / n, 3)).otherwise(0.0),
            "ttr": F.when(F.size("_toks") > 0, T.rounded(F.col("_kinds") / F.size("_toks"), 3)).otherwise(0.0),
            "colon_lists_1k": T.per_thousand(T.regex_count(t, T.COLON_LIST), words),
        }
    ).drop("_t", "_low", "_sents", "_lens", "_paras", "_openers", "_toks", "_again", "_kinds")


ENGLISH = ["words", "n_sents", "mean_len", "sent_cv", "para_cv", "rep_open", "filler_1k", "tell_1k", "em_dash_1k", "passive_ratio", "ttr", "colon_lists_1k"]


def lexicon(spark: SparkSession) -> DataFrame:
    """The dimension of target languages: code, script, and their lists as arrays."""
    def listed(items) -> Column:
        return F.array(*map(F.lit, items)).cast("array<string>")

    rows = F.array(
        *(
            F.struct(F.lit(x["code"]).alias("code"), F.lit(x["script"]).alias("script"), *(listed(lists[x["code"]]).alias(n) for n, lists in LISTS.items()))
            for x in L.LANGUAGES
        )
    )
    return spark.range(1).select(F.inline(rows))


LISTS = {"verbs": L.VERB_ENDINGS, "connectives": L.CONNECTIVES, "calques": L.CALQUES, "formal": L.FORMAL}


def with_lexicon(df: DataFrame, lang: str) -> DataFrame:
    """df with _script and the lists of each row's language (_verbs, ...): a join with a dimension of nine rows. Other
    languages have empty lists and the Latin script."""
    dim = lexicon(df.sparkSession)
    rows = df.join(F.broadcast(dim.select(F.col("code").alias("_code"), F.col("script").alias("_script"), *(F.col(n).alias(f"_{n}") for n in LISTS))), F.col(lang) == F.col("_code"), "left")
    empty = F.array().cast("array<string>")
    return rows.withColumns({"_script": F.coalesce("_script", F.lit("Latin")), **{f"_{n}": F.coalesce(f"_{n}", empty) for n in LISTS}}).drop("_code")


def script_letters(t: Column, script: Column) -> Column:
    """The letters of the row's script; null for unknown scripts. Only the row's own are sought."""
    found = F.lit(None).cast("int")
    for name, (first, last) in L.SCRIPTS.items():
        found = F.when(script == name, T.characters(t, rf"[\x{{{first:04X}}}-\x{{{last:04X}}}&&\p{{L}}]")).otherwise(found)
    return found


def listed_count(t: Column, phrases: str) -> Column:
    """Occurrences of all phrases of an array column."""
    return F.aggregate(phrases, F.lit(0).cast("long"), lambda n, p: n + F.floor((F.octet_length(t) - F.octet_length(F.replace(t, p, F.lit("")))) / F.octet_length(p)))


#: Relative pronouns, with marks as parts of words, and as a word boundary that doesn't count marks has it.
RELATIVE = r"(?<![\p{L}\p{M}\p{N}_])(जो|जिसे|जिसमें|जिससे)(?![\p{L}\p{M}\p{N}_])"


def indic(df: DataFrame, text: str = "text", lang: str = "lang", linguistic: bool = False) -> DataFrame:
    """The columns of df and the measurements of Indic prose, by the lists of each row's language.

    Relative pronouns that end in a matra count where a letter follows, as Python's word boundary has it; linguistic=True
    takes marks as parts of words instead.
    """
    t, low = F.col("_t"), F.col("_low")
    rows = with_lexicon(df, lang).withColumn("_t", T.strip(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumns({"_low": F.lower(t), "_sents": T.sentences(t, ".!?।॥"), "words": F.greatest(T.word_count(t), F.lit(1)).cast("long")})
    words, n = F.col("words"), F.size("_sents")
    ends = F.transform(F.filter(F.transform("_sents", lambda s: T.tokens(F.rtrim(s, F.lit(" .।॥!?")))), lambda w: F.size(w) >= 4), lambda w: F.trim(F.element_at(w, -1), F.lit(" ,.।॥!?:;\"'()")))
    if linguistic:
        relative = T.regex_count(t, RELATIVE)
    else:
        # जिसमें ends in a nasal sign: its boundary, too, is met only before a letter
        relative = sum((T.led_count(t, w, rf"{w}(?<![\p{{L}}\p{{N}}_]{w})(?=[\p{{L}}\p{{N}}_])") for w in L.HINDI_RELATIVES), F.lit(0))
    spaced, doubled = T.regex_count(t, rf"{T.WS}+[,.।;:!?]"), T.regex_count(t, "  +")
    tight, matras, halants = T.regex_count(t, r"[,;:][^ \t\n\r\f\x0B\p{Nd}]"), T.regex_count(t, "[ा-ौ]{3,}"), T.regex_count(t, rf"्{T.WS}")
    rows = rows.withColumns({"_ends": ends, "_spaced": spaced, "_letters": T.characters(t, r"\p{L}"), "_script_letters": script_letters(t, F.col("_script"))})
    final = F.size(F.filter("_ends", lambda w: F.exists("_verbs", lambda v: F.endswith(w, v))))
    return rows.withColumns(
        {
            "n_sents": n.cast("long"),
            "purity": T.rounded(F.when(F.col("_script_letters").isNull(), 1.0).otherwise(T.share(F.col("_script_letters"), F.col("_letters"))), 3),
            "latin": T.rounded(T.latin_share(t), 3),
            "danda_frac": F.when(n > 0, T.rounded(F.size(F.filter("_sents", lambda s: F.right(s, F.lit(1)).isin("।", "॥"))) / n, 3)).otherwise(0.0),
            "mech_1k": T.per_thousand(F.col("_spaced") + doubled + tight + matras + halants, words),
            "sp_punct_1k": T.per_thousand(F.col("_spaced"), words),
            "hyphen_1k": T.per_thousand(T.regex_count(t, rf"{T.WS}-{T.WS}"), words),
            "verb_final": F.when(F.size("_ends") > 0, T.rounded(final / F.size("_ends"), 3)).otherwise(1.0),
            "calque_1k": T.per_thousand(listed_count(low, "_calques"), words),
            "conn_1k": T.per_thousand(listed_count(low, "_connectives"), words),
            "formal_1k": T.per_thousand(listed_count(low, "_formal"), words),
            "rel_1k": T.per_thousand(relative, words),
            "prep_calque_1k": T.per_thousand(T.phrase_count(low, L.HINDI_PREPOSITIONS), words),
            "comma_1k": T.per_thousand(T.phrase_count(t, [",", "،"]), words),
        }
    ).drop("_t", "_sents", "_ends", "_spaced", "_letters", "_script_letters")


def hindi(df: DataFrame, text: str = "text", linguistic: bool = False) -> DataFrame:
    """The same of texts that are all Hindi."""
    return unlisted(indic(df.withColumn("_lang", F.lit("hi")), text, "_lang", linguistic)).drop("_lang")


def unlisted(df: DataFrame) -> DataFrame:
    return df.drop("_low", "_script", *(f"_{n}" for n in LISTS))


HINDI = ["words", "n_sents", "purity", "latin", "danda_frac", "mech_1k", "sp_punct_1k", "hyphen_1k", "verb_final", "calque_1k", "conn_1k", "formal_1k", "rel_1k", "prep_calque_1k", "comma_1k"]
