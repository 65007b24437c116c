"""Scores of 0 to 100 from measurements, with flags and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .features import english, indic, unlisted


def flag(kind: str, severity: Column | str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity")))


def flags(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def errors(of: str = "flags") -> Column:
    return F.size(F.filter(of, lambda f: f["severity"] == "error"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def tenth(x: Column) -> Column:
    """One decimal of a sum; what a sum's last bits leave below a half is rounded away first."""
    return T.rounded(T.rounded(x, 6), 1)


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """The English detector: a score for each parameter, the composite of the rounded ones, and whether all pass."""
    rows = english(df, text)
    scores = {f"s_{k}": T.norm(F.col(k), good, bad) for k, (good, bad) in L.DETECT_BANDS.items()}
    rows = rows.withColumns(scores)
    total = sum((T.rounded(F.col(f"s_{k}"), 1) * F.lit(w) for k, w in L.DETECT_WEIGHTS.items()), F.lit(0.0))
    passed = F.lit(True)
    for k in scores:
        passed = passed & (F.col(k) >= L.DETECT_TARGET)
    rows = rows.withColumn("all_passed", passed).withColumn("_total", total)
    rows = rows.withColumns({k: T.rounded(k, 1) for k in scores})
    return rows.withColumns({"score": T.rounded("_total", 1), "ai_likeness": T.rounded(F.lit(100.0) - F.col("_total"), 1)}).drop("_total")


def ai_likeness_by(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean likeness to generated text and share that passes, by group, likeliest first."""
    rows = detect(df)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), T.rounded(F.avg("ai_likeness"), 4).alias("mean_ai"), F.sum(F.col("all_passed").cast("long")).alias("n_passed"), F.sum("words").alias("words"))


def burstiness(df: DataFrame, text: str = "text") -> DataFrame:
    """Variation of sentence and paragraph lengths and of openings; 75 for texts too short to measure. Lines are the paragraphs."""
    t = T.strip(F.coalesce(F.col(text), F.lit("")))
    rows = english(df, text).withColumns({"_lens": F.filter(F.transform(T.sentences(t, ".!?।॥"), T.word_count), lambda n: n > 1), "_paras": F.filter(F.transform(F.split(t, "\n"), T.word_count), lambda n: n > 3)})
    cv = F.when(F.size("_paras") > 3, T.variation(F.col("_paras"))).otherwise(0.40)
    rows = rows.withColumn("p_cv", cv).withColumn("_short", F.size("_lens") < 5)
    raw = T.norm(F.col("sent_cv"), 0.60, 0.25, 0.50) + T.norm(F.col("p_cv"), 0.45, 0.10, 0.28) + T.norm(F.col("rep_open"), 0.0, 0.20, 0.22)
    long = ~F.col("_short")
    found = flags(
        flag("too_short", "note", F.col("_short")),
        flag("uniform_sentences", "warn", long & (F.col("sent_cv") < 0.42)),
        flag("uniform_paragraphs", "warn", long & (F.size("_paras") > 3) & (F.col("p_cv") < 0.28)),
        flag("repeated_openings", "warn", long & (F.col("rep_open") > 0.08)),
    )
    return rows.withColumns({"burstiness": F.when(F.col("_short"), 75.0).otherwise(T.rounded(clamp(raw), 1)), "p_cv": T.rounded("p_cv", 3), "flags": found}).drop("_lens", "_paras", "_short")


def _indic(df: DataFrame, text: str, lang: str | None) -> DataFrame:
    return indic(df, text, lang) if lang else indic(df.withColumn("_lang", F.lit("hi")), text, "_lang").drop("_lang")


def grammar(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """Script purity, spaced stops and hyphens, other mechanics. lang: the column of the language; without it all is Hindi."""
    rows = _indic(df, text, lang)
    other = F.greatest(F.lit(0.0), F.col("mech_1k") - F.col("sp_punct_1k"))
    blank = F.exists(F.split(F.coalesce(F.col(text), F.lit("x")), "\n\n"), lambda b: T.strip(b) == "")
    foreign = F.col("_script") != "Latin"
    rows = rows.withColumn(
        "flags",
        flags(
            flag("mixed_script", F.when(F.col("purity") < 0.6, "error").otherwise("warn"), foreign & (F.col("purity") < 0.80)),
            flag("loanword_density", "warn", foreign & (F.col("latin") > 0.18)),
            flag("spaced_punctuation", "warn", F.col("sp_punct_1k") > 4),
            flag("spaced_hyphen", "warn", F.col("hyphen_1k") > 2),
            flag("punctuation", "warn", other > 6),
            flag("empty_block", "error", blank),
        ),
    )
    raw = T.norm(F.col("purity"), 0.99, 0.70, 0.28) + T.norm(F.col("sp_punct_1k"), 0.5, 25.0, 0.40) + T.norm(F.col("hyphen_1k"), 0.0, 6.0, 0.17) + T.norm(other, 0.5, 18.0, 0.15)
    return unlisted(rows.withColumn("grammar", T.rounded(clamp(raw - 10.0 * errors()), 1)))


def translationese(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    rows = _indic(df, text, lang)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    over = F.filter("_connectives", lambda c: (F.octet_length(low) - F.octet_length(F.replace(low, c, F.lit("")))) >= 3 * F.octet_length(c))
    rows = rows.withColumn(
        "flags",
        flags(
            flag("prep_calque", "warn", F.col("prep_calque_1k") > 2.5),
            flag("relative_clause", "warn", F.col("rel_1k") > 2.0),
            flag("comma_density", "warn", F.col("comma_1k") > 45),
            flag("calque", "warn", F.exists("_calques", lambda c: F.contains(low, c))),
            flag("connective_overuse", "warn", F.size(over) > 0),
            flag("word_order", "note", F.col("verb_final") < 0.55),
        ),
    )
    raw = T.norm(F.col("prep_calque_1k"), 0.4, 9.0, 0.34) + T.norm(F.col("rel_1k"), 0.4, 3.5, 0.22) + T.norm(F.col("comma_1k"), 22.0, 68.0, 0.20) + T.norm(F.col("calque_1k"), 0.0, 4.0, 0.14) + T.norm(F.col("conn_1k"), 1.2, 9.0, 0.10)
    return unlisted(rows.withColumn("translationese", T.rounded(clamp(raw), 1)))


def _honorific(form: str) -> str:
    """A form as Python's \\w has it: marks are no word characters, so that a form that ends in a letter may be followed by one."""
    return rf"{form}(?<![\p{{L}}\p{{N}}_]{form})(?![\p{{L}}\p{{N}}_])"


LEVELS = ("formal", "informal", "intimate")


def register(df: DataFrame, text: str = "text", lang: str | None = None, expected: str = "formal") -> DataFrame:
    t, code = F.coalesce(F.col(text), F.lit("")), F.col(lang) if lang else F.lit("hi")

    def count(level: str) -> Column:
        found = F.lit(0)
        for name, forms in L.HONORIFICS.items():
            found = F.when(code == name, sum((T.led_count(t, f, _honorific(f)) for f in forms[level]), F.lit(0))).otherwise(found)
        return found.cast("long")

    formal = F.lit(0).cast("long")
    for name, words in L.FORMAL.items():
        formal = F.when(code == name, T.phrase_count(F.lower(t), words)).otherwise(formal)
    rows = df.withColumns({**{f"h_{level}": count(level) for level in LEVELS}, "_words": F.greatest(F.lit(1.0), T.word_count(t) / F.lit(1000.0)), "_f": formal})
    names = [f"h_{level}" for level in LEVELS]
    rows = rows.withColumns({"_total": sum((F.col(n) for n in names), F.lit(0)), "_most": F.greatest(*names)})
    total, most = F.col("_total"), F.col("_most")
    dominant = F.coalesce(*(F.when(F.col(n) == most, F.lit(n[2:])) for n in names))
    rows = rows.withColumns({"consistency": F.when(total >= 4, most / total).otherwise(1.0), "_formal": F.col("_f") / F.col("_words"), "_many": total >= 4, "dominant": F.when(total >= 4, dominant)})
    rows = rows.withColumn(
        "flags",
        flags(
            flag("honorific_mix", F.when(F.col("consistency") < 0.7, "error").otherwise("warn"), F.col("_many") & (F.col("consistency") < 0.85)),
            flag("honorific_level", "warn", F.col("_many") & (F.col("dominant") != expected)),
            flag("over_formal", "warn", F.col("_formal") > 9),
        ),
    )
    raw = T.norm(F.col("consistency"), 1.0, 0.55, 0.65) + T.norm(F.col("_formal"), 2.0, 18.0, 0.35)
    return rows.withColumns({"register": T.rounded(clamp(raw), 1), "consistency": T.rounded("consistency", 3), "formal_per_1k": T.rounded("_formal", 1)}).drop("_words", "_f", "_formal", "_many", "_total", "_most")


def reviewed(df: DataFrame, reviews: DataFrame, key: str, neutral: float = 75.0) -> DataFrame:
    """df with native_review: the reviewer's score (reviews: key, score), or the neutral one where there was no review."""
    return df.join(reviews.select(key, F.col("score").alias("native_review")), key, "left").withColumn("native_review", F.coalesce("native_review", F.lit(neutral)))


def renormalised(df: DataFrame, measured: tuple[str, ...] = ("grammar", "translationese", "register", "burstiness")) -> DataFrame:
    """hls, ai_pct: the composite over the scores that a text alone has, by their weights' share."""
    whole = sum(L.COMPOSITE_WEIGHTS[k] for k in measured)
    total = sum((F.col(k) * F.lit(L.COMPOSITE_WEIGHTS[k]) for k in measured), F.lit(0.0)) / F.lit(whole)
    return df.withColumns({"hls": tenth(total), "ai_pct": tenth(F.lit(100.0) - total)})


def verdict(separation: DataFrame, gap: str = "gap", auc: str = "auc") -> DataFrame:
    """Whether a score tells classes apart: usable from an AUC of 0.80 and a gap of 6, weak from 0.65."""
    usable = (F.col(auc) >= 0.80) & (F.col(gap) >= 6)
    return separation.withColumn("verdict", F.when(usable, "usable").when(F.col(auc) >= 0.65, "weak").otherwise("not usable"))


#: Weights of the English draft's score, its least, and the highest likeness to generated text. Fixed values.
DRAFT_WEIGHTS, DRAFT_LEAST, DRAFT_LIKENESS = {"aeo": 0.40, "burstiness": 0.35, "native_review": 0.25}, 70.0, 20.0
DRAFT_BLOCKING = ["locked_term", "medical_claim", "hedge_lost", "protected_span", "empty_block"]


def english_gate(df: DataFrame) -> DataFrame:
    """draft_score, blocking, passed of English drafts with aeo, burstiness, native_review, ai_likeness and flags."""
    total = sum((F.col(k) * F.lit(w) for k, w in DRAFT_WEIGHTS.items()), F.lit(0.0))
    blocking = F.size(F.filter("flags", lambda f: (f["severity"] == "error") & f["kind"].isin(DRAFT_BLOCKING)))
    rows = df.withColumns({"_total": total, "blocking": blocking.cast("long")})
    passed = (F.col("_total") >= DRAFT_LEAST) & (F.col("ai_likeness") <= DRAFT_LIKENESS) & (F.col("blocking") == 0)
    return rows.withColumns({"draft_score": tenth(F.col("_total")), "passed": passed}).drop("_total")


def composite(df: DataFrame) -> DataFrame:
    """Human likeness from the six scores, and whether no blocking error stands. Scores never gate."""
    total = sum((F.col(k) * F.lit(w) for k, w in L.COMPOSITE_WEIGHTS.items()), F.lit(0.0))
    blocking = F.filter("flags", lambda f: (f["severity"] == "error") & f["kind"].isin(L.BLOCKING))
    return df.withColumns({"human_likeness": tenth(total), "ai_pct": tenth(F.lit(100.0) - total), "passed": F.size(blocking) == 0})


def brief(df: DataFrame, limit: int = 14) -> DataFrame:
    """Flags as lines, errors first, stable, so many at most (column brief)."""
    def of(severity: str) -> Column:
        return F.filter("flags", lambda f: f["severity"] == severity)

    ranked = F.flatten(F.array(*map(of, ("error", "warn", "note"))))
    return df.withColumn("brief", F.transform(F.slice(ranked, 1, limit), lambda f: F.concat(F.lit("["), f["severity"], F.lit("] "), f["kind"])))
