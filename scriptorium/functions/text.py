"""Text functions from column to column, all on the JVM.

Character classes are spelled out: white space is ASCII's, a word character is a letter, a digit in any script, or "_".
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L

WS = r"[ \t\n\r\f\x0B]"
NOT_WS = r"[^ \t\n\r\f\x0B]"
SPACES = " \t\n\r\f\x0b"
NOT_WORD = r"[^\p{L}\p{N}_]"
PASSIVE = rf"(?i)(^|{NOT_WORD})(is|are|was|were|be|been|being|get|gets|got)[ \t\n\r\f\x0B]+([\p{{L}}\p{{N}}_]+ly[ \t\n\r\f\x0B]+)?[\p{{L}}\p{{N}}_]+(ed|en|wn|ne)({NOT_WORD}|$)"
COLON_LIST = r":[ \t\n\r\f\x0B]*[\p{L}\p{N}_]+[^\n]*?,[ \t\n\r\f\x0B]*[\p{L}\p{N}_]+[^\n]*?,[ \t\n\r\f\x0B]*(and[ \t\n\r\f\x0B]+)?[\p{L}\p{N}_]+"


def strip(t: Column) -> Column:
    return F.trim(t, F.lit(SPACES))


def clean(t: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(t, f"{WS}+", " "))


def tokens(t: Column) -> Column:
    return F.filter(F.split(t, f"{WS}+"), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.regexp_count(F.coalesce(t, F.lit("")), F.lit(f"{NOT_WS}+"))


def after(stops: str) -> str:
    """White space after one of the stops. What a pattern begins with is tried at every character of a text: a class is
    passed over faster than a look behind, which therefore comes second, here and in the patterns below."""
    return f"{WS}(?<=[{stops}]{WS}){WS}*"


def sentences(t: Column, stops: str = ".!?") -> Column:
    return F.filter(F.transform(F.split(t, after(stops)), strip), lambda s: s != "")


def regex_count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def led_count(t: Column, phrase: str, pattern: str) -> Column:
    """Matches of a pattern that begins with a phrase; texts without the phrase are not passed over. t isn't null."""
    return F.when(F.contains(t, F.lit(phrase)), regex_count(t, pattern)).otherwise(0)


def literal_count(t: Column, phrase: str) -> Column:
    """Occurrences that don't overlap. By bytes, whose number a string has; that of its characters is counted each time."""
    return (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(phrase), F.lit("")))) / F.lit(len(phrase.encode()))


def phrase_count(t: Column, phrases: list[str]) -> Column:
    total = F.lit(0.0)
    for p in phrases:
        total = total + literal_count(t, p)
    return total.cast("long")


def phrases_present(t: Column, phrases: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many decimals, halves away from zero, by the double that is its multiple: the decimal digits that a double is
    written with may stand on the other side of a half than those of its multiple."""
    x, times = F.col(x) if isinstance(x, str) else x, F.lit(10.0**digits)
    return F.round(x * times) / times


def per_thousand(n: Column, words: Column) -> Column:
    return rounded(n / (words / F.lit(1000.0)), 2)


def variation(values: Column) -> Column:
    """Standard deviation over mean, from whole-number moments, so that the order of the values doesn't matter."""
    n = F.size(values)
    s = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return F.sqrt((n * q - s * s).cast("double")) / s


def characters(t: Column, kind: str) -> Column:
    """How many characters of a kind (a class of one) a text has: what it is shorter by without their runs. A count of
    matches would make an array with a string for each."""
    return F.length(t) - F.length(F.regexp_replace(t, f"{kind}+", ""))


def share(own: Column, letters: Column) -> Column:
    return F.when(letters == 0, 0.0).otherwise(own / letters)


def script_share(t: Column, script: str) -> Column:
    """Share of the letters that are of the script; 1 for unknown scripts, 0 without letters."""
    if script not in L.SCRIPTS:
        return F.lit(1.0)
    first, last = L.SCRIPTS[script]
    return share(characters(t, rf"[\x{{{first:04X}}}-\x{{{last:04X}}}&&\p{{L}}]"), characters(t, r"\p{L}"))


def latin_share(t: Column) -> Column:
    own = regex_count(t, rf"[A-Za-z](?<!{NOT_WS}[A-Za-z])[A-Za-z'.-]*+(?!{NOT_WS})")
    return own / F.greatest(word_count(t), F.lit(1))


def ascii_digits(t: Column) -> Column:
    """Only texts with a character between the first and the last of these digits are translated."""
    first, last = min(L.INDIC_DIGITS), max(L.INDIC_DIGITS)
    return F.when(F.rlike(t, F.lit(rf"[\x{{{ord(first):X}}}-\x{{{ord(last):X}}}]")), F.translate(t, L.INDIC_DIGITS, L.ASCII_DIGITS)).otherwise(t)


def syllables(t: Column) -> Column:
    """Syllables of all words (runs of A-Z, a-z and apostrophes) of a text, by rule of thumb.

    A word of up to three letters has one; others lose a silent ending and a "y" in front, and have one for each one or two
    vowels in a row, one at least. All words are treated at once, by passes over the text: no array of words is made. So there
    is one for each word, and one more for each vowel or two but the first in words that keep any.
    """
    words = F.concat(F.lit(" "), F.lower(F.regexp_replace(F.replace(t, F.lit("'"), F.lit("")), "[^A-Za-z]+", " ")))
    long = F.regexp_replace(words, " [a-z]{1,3}(?![a-z])", "")
    cut = F.regexp_replace(F.regexp_replace(long, "(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?![a-z])", ""), "y(?<![a-z]y)", "")
    return regex_count(words, "[a-z]+") + regex_count(cut, "[aeiouy]{1,2}") - regex_count(cut, "[aeiouy][a-z]*+")


def with_flesch(df: DataFrame, text: str = "text", name: str = "flesch") -> DataFrame:
    """df with the reading ease of a text, 0 to 100, one decimal."""
    t = F.coalesce(F.col(text), F.lit(""))
    several = F.filter(F.split(strip(t), after(".!?।॥")), lambda s: F.rlike(s, F.lit(f"{NOT_WS}{WS}+{NOT_WS}")))
    rows = df.withColumns({"_fw": regex_count(t, "[A-Za-z']+"), "_fs": F.size(several), "_fy": syllables(t)})
    ease = F.lit(206.835) - F.lit(1.015) * (F.col("_fw") / F.col("_fs")) - F.lit(84.6) * (F.col("_fy") / F.col("_fw"))
    found = F.when((F.col("_fs") == 0) | (F.col("_fw") == 0), 0.0).otherwise(rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)), 1))
    return rows.withColumn(name, found).drop("_fw", "_fs", "_fy")


def flesch_band(ease: Column) -> Column:
    return F.when(ease >= 80, "very easy").when(ease >= 70, "easy").when(ease >= 60, "fairly easy").when(ease >= 50, "standard").when(ease >= 30, "fairly hard").otherwise("hard")


def token_set(t: Column, stop: list[str], longer_than: int = 2, pattern: str = "[a-z0-9]+") -> Column:
    """The distinct words of a text, in order: pattern is a class of characters and a plus."""
    words = F.regexp_extract_all(F.lower(t), F.lit(f"{pattern[:-1]}{{{longer_than + 1},}}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>"))


def frequent_terms(t: Column, stop: list[str], longer_than: int, most: int) -> Column:
    """Array of struct<term,n>: the most frequent of the words of a text, ties by first place. Counted within the row, in an
    Arrow function: words aren't shuffled."""

    @F.arrow_udf("array<struct<term:string,n:long>>")
    def found(texts: pa.Array) -> pa.Array:
        word, stops, out = re.compile(f"[a-z]{{{longer_than + 1},}}"), frozenset(stop), []
        for text in texts:
            counts = Counter(w for w in word.findall(text.as_py() or "") if w not in stops)  # in the order of their first places
            out.append([{"term": w, "n": n} for w, n in sorted(counts.items(), key=lambda x: -x[1])[:most]])
        return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))

    return found(F.lower(t))


def serp_cut(t: Column, most: int) -> Column:
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose compatibility decomposition is ASCII letters and marks, and those letters."""
    import unicodedata

    found = {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128)
        if len(plain) == 1 and plain.isalnum():
            found[chr(code)] = plain
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _accents()


def _capitals() -> tuple[str, str]:
    """Letters whose capitals are several letters, and the one letter that stands for these, where there is one."""
    found = {chr(code): chr(code).title() for code in range(0x80, 0x10000) if len(chr(code).upper()) > 1}
    found = {c: t for c, t in found.items() if len(t) == 1} | {"ß": "ẞ"}
    return "".join(found), "".join(found.values())


SEVERAL, ONE = _capitals()


def capital(c: Column) -> Column:
    """A character as one capital, so that no title grows by it; a letter that has none stays."""
    return F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.translate(c, SEVERAL, ONE))


def folded(t: Column) -> Column:
    """Letters without their accents; other letters beyond ASCII go."""
    return F.regexp_replace(F.translate(F.coalesce(t, F.lit("")), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def slug(t: Column, most: int = 60) -> Column:
    """Of the whole text; cut before the word that passes the length."""
    plain = F.lower(folded(t))
    whole = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(whole, 1, most)
    cut = F.when(F.length(whole) > most, F.when(F.contains(head, F.lit("-")), F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)).otherwise(whole)
    return F.when(cut == "", "untitled").otherwise(cut)


def chunk_sentences(t: Column, limit: int) -> Column:
    """Sentences packed greedily into chunks of at most so many characters; a longer sentence stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, part: Column) -> Column:
        over = (acc["buf"] != "") & (F.length(acc["buf"]) + 1 + F.length(part) > limit)
        return F.struct(F.when(over, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]).alias("out"), F.when(over, part).otherwise(F.trim(F.concat(acc["buf"], F.lit(" "), part))).alias("buf"))

    text = strip(t)
    packed = F.aggregate(F.split(text, f"(?<=[.!?।॥]){WS}+"), start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def norm(value: Column, good: float, bad: float, weight: float = 1.0) -> Column:
    """0 at bad, 100 at good, straight between and flat outside; either may be the larger. Times weight, which goes first, as
    in the checking SQL: in the other order a product may end below a half that this one meets."""
    if good == bad:
        return F.lit(weight * 100.0)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(float(bad))) / F.lit(float(good - bad))))
    return (part if weight == 1.0 else F.lit(weight) * part) * F.lit(100.0)


#: Question words at the start of a line, and Hindi ones. A Python word boundary doesn't count a matra as part of the word,
#: so words that end in one are met only before a letter.
QUESTION = (
    r"(?im)[?？]|^(what|why|how|when|where|which|who|can|is|are|does|do|should|will)(?![\p{L}\p{N}_])"
    r"|(?<![\p{L}\p{N}_])(क्या|कैसे)(?=[\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(क्यों|कहाँ)(?=[\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(कब|कौन|किस)(?![\p{L}\p{N}_])"
)


def is_question(t: Column) -> Column:
    return F.rlike(strip(F.coalesce(t, F.lit(""))), F.lit(QUESTION))


def escape_html(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def utf16_length(t: Column) -> Column:
    """Code units, in which document services count: characters beyond the first plane take two."""
    return F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def column_letter(index: int) -> str:
    """The name of a spreadsheet's column, from 0."""
    out, index = "", index + 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def json_part(t: Column) -> Column:
    """The JSON object in a reply: without a code fence, from the first brace to the last; null without one."""
    inner = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.nullif(F.regexp_extract(F.when(inner != "", inner).otherwise(t), r"(?s)(\{.*\})", 1), F.lit(""))
