"""Differences between two versions of a text: numbers, protected spans, terms, claims and hedges."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ENUMERATOR = r"[0-9](?<![0-9][0-9])[0-9]?[.)](?=[ \t\n\r\f\x0B]|$)"
#: Kinds of protected span, first claims first. Fixed values.
PROTECTED = {
    "url": r"https?://[^\s<>\"')]+",
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+",
    "phone": r"(?:\+91[\s-]?)?[6-9][0-9]{9}(?![\p{L}\p{N}_])",
    "dosage": r"(?i)[0-9]+(?:[.,][0-9]+)?\s*(?:mg|ml|mcg|gm|kg|g|IU)(?![\p{L}\p{N}_])",
    "price_inr": r"(?:₹|Rs\.?|INR)\s*[0-9][0-9,]*(?:\.[0-9]+)?",
    "percent": r"[0-9]+(?:\.[0-9]+)?\s*%",
    "number": r"(?<![\p{L}\p{N}_])[0-9]+(?:[.,][0-9]+)*(?![\p{L}\p{N}_])",
}


def numbers(t: Column) -> Column:
    """The distinct numeric values of a text: digits of any script, thousands commas out, enumerators out, no leading zeros."""
    t = T.ascii_digits(F.coalesce(t, F.lit("")))
    t = F.regexp_replace(t, r",(?<=[0-9],)(?=[0-9]{3}(?![\p{L}\p{N}_]))", "")
    t = F.regexp_replace(t, ENUMERATOR, " ")
    found = F.transform(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda v: F.regexp_replace(v, "^0+", ""))
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: F.when(v == "", "0").otherwise(v))))


def number_diff(df: DataFrame, source: str, target: str) -> DataFrame:
    """invented and dropped: numbers that only one side has."""
    rows = df.withColumns({"_s": numbers(F.col(source)), "_t": numbers(F.col(target))})
    return rows.withColumns({"invented": F.array_except("_t", "_s"), "dropped": F.array_except("_s", "_t")}).drop("_s", "_t")


def canonical(kind: Column, value: Column) -> Column:
    v = F.regexp_replace(F.lower(value), r"[ \t\n\r\f\x0B,]", "")
    return F.when(kind == "price_inr", F.regexp_replace(v, r"^(rs\.?|inr|₹)", "")).otherwise(v)


#: Rows of a batch that are Python objects at once.
PIECE = 256


def _pieces(make, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """make() of the columns' values as lists, piece after piece, so that a batch's values never are Python objects all at once."""
    n = len(columns[0])
    return pa.concat_arrays([pa.array(make(*(c.slice(i, PIECE).to_pylist() for c in columns)), kind) for i in range(0, n, PIECE)] or [pa.array([], kind)])


SPAN = "struct<kind:string,start:int,end:int,value:string>"
_SPACES = r"[ \t\n\r\f\x0B]"


def claims(text: str, rules: list[tuple[str, regex.Pattern]]) -> list[tuple[int, int, str]]:
    """Start, end and kind of the protected spans of a text, in text order.

    Kinds are sought one after another in the whole text, from left to right; a match that overlaps what an earlier kind, or
    an earlier match, has claimed is none, and what is left of it isn't sought again.
    """
    starts, taken = [], []
    for kind, pattern in rules:
        for m in pattern.finditer(text):
            a, b = m.span()
            at = bisect_left(starts, a)
            if a < b and (at == len(taken) or taken[at][0] >= b) and (not at or taken[at - 1][1] <= a):
                starts.insert(at, a)
                taken.insert(at, (a, b, kind))
    return taken


def _rules(kinds: dict[str, str]) -> list[tuple[str, regex.Pattern]]:
    # white space is ASCII's, as in the other engines
    return [(k, regex.compile(p.replace(r"[\s-]", r"[ \t\n\r\f\x0B-]").replace(r"[^\s", r"[^ \t\n\r\f\x0B").replace(r"\s", _SPACES))) for k, p in kinds.items()]


def spans(t: Column, kinds: dict[str, str] = PROTECTED) -> Column:
    """Array of SPAN, in text order; places are in characters from 0, values without white space around. Null for null."""

    @F.arrow_udf(f"array<{SPAN}>")
    def found(texts: pa.Array) -> pa.Array:
        rules = _rules(kinds)

        def make(values):
            return [None if text is None else [{"kind": k, "start": a, "end": b, "value": text[a:b].strip()} for a, b, k in claims(text, rules)] for text in values]

        return _pieces(make, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])), texts)

    return found(t)


def protected_spans(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, kind, value: every protected span; digits of any script as ASCII's, enumerators left out."""
    rest = F.regexp_replace(T.ascii_digits(F.coalesce(F.col(text), F.lit(""))), ENUMERATOR, "  ")
    return df.select(*keys, F.explode(spans(rest)).alias("_s")).select(*keys, "_s.kind", "_s.value")


def masked(df: DataFrame, text: str, token: str = "⦉{}⦊", kinds: dict[str, str] = PROTECTED) -> DataFrame:
    """df with masked, where each span stands as a numbered token that no language has, and held, the spans by number.

    A token that the text has of itself is held, too, so that it comes back as it is.
    """
    before, after = token.split("{}")
    own = {"token": f"{regex.escape(before)}[ \\t\\n\\r\\f\\x0B]*[0-9]+[ \\t\\n\\r\\f\\x0B]*{regex.escape(after)}", **kinds}

    @F.arrow_udf("struct<masked:string,held:array<string>>")
    def made(texts: pa.Array) -> pa.Array:
        rules = _rules(own)

        def one(t):
            parts, held, end = [], [], 0
            for a, b, _ in claims(t, rules):
                parts += [t[end:a], before, str(len(held)), after]
                held.append(t[a:b])
                end = b
            return {"masked": "".join([*parts, t[end:]]), "held": held}

        return _pieces(lambda values: list(map(one, values)), pa.struct([("masked", pa.string()), ("held", pa.list_(pa.string()))]), texts)

    rows = df.withColumn("_m", made(T.ascii_digits(F.coalesce(F.col(text), F.lit("")))))
    return rows.withColumns({"masked": F.col("_m.masked"), "held": F.col("_m.held")}).drop("_m")


def unmasked(df: DataFrame, text: str = "masked", held: str = "held", token: str = "⦉{}⦊") -> DataFrame:
    """df with unmasked: the tokens replaced by the spans they stand for, also where spaces or capitals came into them.

    One pass over the text; a number that nothing is held for stays as it is.
    """
    before, after = token.split("{}")

    @F.arrow_udf("string")
    def filled(texts: pa.Array, values: pa.Array) -> pa.Array:
        pattern = regex.compile(rf"(?i){regex.escape(before)}{_SPACES}*([0-9]+){_SPACES}*{regex.escape(after)}")

        def one(t, own):
            return None if t is None else pattern.sub(lambda m, own=own or []: own[int(m[1])] if int(m[1]) < len(own) else m[0], t)

        return _pieces(lambda *both: list(map(one, *both)), pa.string(), texts, values)

    return df.withColumn("unmasked", filled(F.col(text), F.col(held)))


#: What a machine translator must not reword: numbers stay visible, so that it can inflect around them.
UNWORDED = {k: PROTECTED[k] for k in ("url", "email", "phone")}


def protected_diff(df: DataFrame, source: str, target: str, keys: list[str]) -> DataFrame:
    """keys, kind, value, issue (invented or dropped), n: the multiset difference of protected spans by canonical value."""
    def counted(side: str, sign: int) -> DataFrame:
        spans = protected_spans(df, side, keys)
        return spans.select(*keys, "kind", canonical(F.col("kind"), F.col("value")).alias("value"), F.lit(sign).alias("_n"))

    both = counted(source, 1).unionAll(counted(target, -1)).groupBy(*keys, "kind", "value").agg(F.sum("_n").alias("_n"))
    return both.filter("_n != 0").select(*keys, "kind", "value", F.when(F.col("_n") > 0, "dropped").otherwise("invented").alias("issue"), F.abs("_n").cast("long").alias("n"))


#: Defaults of the guard: names that must survive (a project adds its own), claims that must not be added, hedges of which
#: one must stay. Fixed values.
NEVER = ["WhatsApp", "Instagram", "YouTube", "Google", "Facebook"]
CLAIMS = ["cure", "guaranteed", "100%", "permanent cure", "no side effects", "instant relief", "miracle", "इलाज की गारंटी", "पूर्ण इलाज", "गारंटी", "चमत्कारी"]
HEDGES = ["may", "can help", "consult", "doctor", "physician", "supervision", "सलाह", "डॉक्टर", "चिकित्सक", "मदद कर सकता", "हो सकता"]


def guard(df: DataFrame, source: str, target: str, never: list[str] = NEVER, claims: list[str] = CLAIMS, hedges: list[str] = HEDGES) -> DataFrame:
    """missing_terms, new_claims, hedge_lost. Substrings count, in lower case: both texts in it are columns, as a function of
    an array's element computes what it names anew for each element."""
    rows = df.withColumns({"_gs": F.lower(F.coalesce(F.col(source), F.lit(""))), "_gt": F.lower(F.coalesce(F.col(target), F.lit("")))})
    s, t = F.col("_gs"), F.col("_gt")

    def pick(terms: list[str], here: Column, not_there: Column) -> Column:
        return F.filter(F.array(*map(F.lit, terms)), lambda x: F.contains(here, F.lower(x)) & ~F.contains(not_there, F.lower(x)))

    def hedged(where: Column) -> Column:
        return F.exists(F.array(*map(F.lit, hedges)), lambda x: F.contains(where, F.lower(x)))

    return rows.withColumns({"missing_terms": pick(never, s, t), "new_claims": pick(claims, t, s), "hedge_lost": hedged(s) & ~hedged(t)}).drop("_gs", "_gt")


def guard_flags(df: DataFrame, source: str, target: str, **lists: list[str]) -> DataFrame:
    """df with flags: a number that only one side has, a lost name, a stronger claim, a lost hedge. All are errors."""
    rows = guard(number_diff(df, source, target), source, target, **lists)

    def of(kind: str, when: Column) -> Column:
        return F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), F.lit("error").alias("severity"))))

    numbers = F.transform(F.concat("invented", "dropped"), lambda _: F.struct(F.lit("protected_span").alias("kind"), F.lit("error").alias("severity")))
    found = F.flatten(F.array_compact(F.array(numbers, of("locked_term", F.size("missing_terms") > 0), of("medical_claim", F.size("new_claims") > 0), of("hedge_lost", F.col("hedge_lost")))))
    return rows.withColumn("flags", found).drop("invented", "dropped", "missing_terms", "new_claims", "hedge_lost")


def _bag(t: str) -> Column:
    rest = F.regexp_replace(T.ascii_digits(F.coalesce(F.col(t), F.lit(""))), ENUMERATOR, "  ")
    return F.transform(spans(rest), lambda s: F.concat(s["kind"], F.lit(":"), canonical(s["kind"], s["value"])))


def _differences(a: str, b: str) -> Column:
    """By how much two bags differ, summed over their values: both are sorted together, and runs of equal values are counted."""
    signed = lambda bag, sign: F.transform(bag, lambda v: F.struct(v.alias("v"), F.lit(sign).alias("n")))
    rows = F.array_sort(F.concat(signed(a, 1), signed(b, -1)))
    state = lambda v, run, total: F.struct(v.alias("v"), run.alias("run"), total.alias("total"))

    def add(s: Column, x: Column) -> Column:
        same = s["v"].eqNullSafe(x["v"])
        return state(x["v"], F.when(same, s["run"] + x["n"]).otherwise(x["n"]), s["total"] + F.when(same, 0).otherwise(F.abs(s["run"])))

    return F.aggregate(rows, state(F.lit(None).cast("string"), F.lit(0), F.lit(0)), add, lambda s: s["total"] + F.abs(s["run"]))


def fidelity(df: DataFrame, source: str, target: str, stop: list[str], translated: str | None = None) -> DataFrame:
    """Content-word overlap, length ratio, flags and the score of a round trip (source, target: back in its language).

    Errors cost 12 each: protected spans that differ as multisets, a target under 0.7 of the length and, of the translated
    text if there is one, what guard_flags() finds. Without a target only these count.
    """
    s, t = (T.token_set(T.ascii_digits(F.coalesce(F.col(c), F.lit(""))), stop, 3, "[a-z]+") for c in (source, target))
    rows = guard_flags(df, source, translated) if translated else df.withColumn("flags", F.array().cast("array<struct<kind:string,severity:string>>"))
    rows = rows.withColumns({"_a": s, "_b": t, "_ws": T.word_count(F.col(source)), "_wt": T.word_count(F.col(target)), "_none": F.col(target).isNull()})
    rows = rows.withColumns({"overlap": F.when(F.size("_a") == 0, 1.0).otherwise(F.size(F.array_intersect("_a", "_b")) / F.size("_a")), "length_ratio": F.when(F.col("_ws") == 0, 1.0).otherwise(F.col("_wt") / F.col("_ws")), "_ba": _bag(source), "_bb": _bag(target)})
    rows = rows.withColumn("_spans", _differences("_ba", "_bb"))
    there, ratio = ~F.col("_none"), F.col("length_ratio")

    def one(kind: str, severity: str, when: Column) -> Column:
        return F.when(there & when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))

    lost = F.when(there, F.transform(F.array_repeat(F.lit(0), F.col("_spans")), lambda _: F.struct(F.lit("protected_span").alias("kind"), F.lit("error").alias("severity"))))
    drift = (F.col("overlap") < 0.55) & (F.size(F.array_except("_a", "_b")) > 0)
    own = F.array_compact(F.array(one("meaning_drift", "warn", drift), one("truncation", "error", ratio < 0.7), one("padding", "warn", (ratio >= 0.7) & (ratio > 1.45)), F.when(F.col("_none"), F.struct(F.lit("fidelity").alias("kind"), F.lit("note").alias("severity")))))
    rows = rows.withColumn("flags", F.flatten(F.array_compact(F.array("flags", lost, own))))
    wrong = F.size(F.filter("flags", lambda f: f["severity"] == "error"))
    raw = F.when(there, T.norm(F.col("overlap"), 0.80, 0.35, 0.55) + T.norm(F.least("length_ratio", F.lit(1.0)), 1.0, 0.60, 0.25) + 20.0).otherwise(100.0) - 12.0 * wrong
    return rows.withColumns({"fidelity": T.rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1), "overlap": T.rounded("overlap", 3), "length_ratio": T.rounded("length_ratio", 3)}).drop("_a", "_b", "_ba", "_bb", "_ws", "_wt", "_none", "_spans")


def claim_audit(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, value, context: every protected span of a draft, which has no source to hold it against, with the first
    sentence that has it, for a person to verify."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.array_distinct(F.transform(spans(F.regexp_replace(T.ascii_digits(t), ENUMERATOR, "  ")), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    rows = df.select(key, T.sentences(t, ".!?।॥").alias("_sents"), F.explode(found).alias("_s"))
    first = F.get(F.filter("_sents", lambda s: F.contains(s, F.col("_s.value"))), F.lit(0))
    return rows.select(key, "_s.kind", "_s.value", F.substring(F.coalesce(first, F.lit("")), 1, 180).alias("context"))


def fix_verdict(df: DataFrame, source: str, target: str) -> DataFrame:
    """Invented numbers block a fix, dropped ones ask for review."""
    rows = number_diff(df, source, target)
    return rows.withColumn("verdict", F.when(F.size("invented") > 0, "blocking").when(F.size("dropped") > 0, "review").otherwise("safe"))


def regression_accepted(df: DataFrame, before: str, after: str) -> DataFrame:
    """A rewrite is taken if it brings no blocking defect that wasn't there and removes one. before, after: arrays of signatures."""
    return df.withColumn("accepted", (F.size(F.array_except(after, before)) == 0) & (F.size(F.array_distinct(after)) < F.size(F.array_distinct(before))))
