"""Pieces of DuckDB SQL for the checking queries, written apart from the operators they check."""

from __future__ import annotations

from html.entities import name2codepoint

from ..functions import lexicons as L

WS = r"[ \t\n\r\f\x0B]"
CHARS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"trim({t}, {CHARS})"


def toks(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda w: w <> '')"


def wc(t: str) -> str:
    return f"len({toks(t)})"


def sents(t: str, stops: str = ".!?") -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({t}, '([{stops}]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def rx(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {quoted(pattern)}))"


def hits(t: str, phrases: list[str]) -> str:
    """Occurrences of all phrases."""
    return "(" + " + ".join(f"(length({t}) - length(replace({t}, {quoted(p)}, ''))) // {len(p)}" for p in phrases) + ")"


def per1k(n: str) -> str:
    return f"round({n} / (words / 1000.0::DOUBLE), 2)"


def cv(xs: str) -> str:
    return f"sqrt((len({xs}) * list_sum(list_transform({xs}, lambda x: x * x)) - list_sum({xs}) * list_sum({xs}))::DOUBLE) / list_sum({xs})"


def norm(v: str, good: float, bad: float) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({v} - {bad}::DOUBLE) / {good - bad!r}::DOUBLE)) * 100.0::DOUBLE"


def names(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


PASSIVE = rf"(?i)(^|[^\p{{L}}\p{{N}}_])(is|are|was|were|be|been|being|get|gets|got){WS}+([\p{{L}}\p{{N}}_]+ly{WS}+)?[\p{{L}}\p{{N}}_]+(ed|en|wn|ne)([^\p{{L}}\p{{N}}_]|$)"
COLON = rf":{WS}*[\p{{L}}\p{{N}}_]+[^\n]*?,{WS}*[\p{{L}}\p{{N}}_]+[^\n]*?,{WS}*(and{WS}+)?[\p{{L}}\p{{N}}_]+"


def english(source: str = "documents", keep: str = "doc_id, lang, source, text") -> str:
    """CTEs up to `f`, with the English measurements."""
    openers = f"list_transform(list_filter(list_transform(sents, lambda s: {toks('s')}), lambda w: len(w) > 3), lambda w: lower(w[1] || ' ' || w[2]))"
    return f"""WITH a AS (SELECT {keep}, {strip("coalesce(text, '')")} AS t FROM {source}),
b AS (SELECT *, lower(t) AS low, {sents("t")} AS sents, greatest(1, {wc("t")}) AS words FROM a),
c AS (SELECT *, list_filter(list_transform(sents, lambda s: {wc("s")}), lambda n: n > 1) AS lens, list_filter(list_transform(string_split(t, chr(10)), lambda p: {wc("p")}), lambda n: n > 3) AS paras,
    {openers} AS openers, {toks("low")} AS ws FROM b),
f AS (SELECT {keep}, t, low, sents, lens, paras, words::BIGINT AS words, len(sents)::BIGINT AS n_sents,
    CASE WHEN len(lens) > 0 THEN round(list_sum(lens) / len(lens), 1) ELSE 0.0 END::DOUBLE AS mean_len,
    CASE WHEN len(lens) > 2 THEN round({cv("lens")}, 3) ELSE 0.0 END::DOUBLE AS sent_cv,
    CASE WHEN len(paras) > 3 THEN round({cv("paras")}, 3) ELSE 0.0 END::DOUBLE AS para_cv,
    CASE WHEN len(openers) = 0 THEN 0.0 ELSE round(len(list_filter(openers, lambda o: len(list_filter(openers, lambda q: q = o)) >= 3)) / len(openers), 3) END::DOUBLE AS rep_open,
    {per1k(hits("low", L.FILLER))} AS filler_1k, {per1k(hits("low", L.TELLS))} AS tell_1k, {per1k(hits("t", ["—", " - "]))} AS em_dash_1k,
    CASE WHEN len(sents) > 0 THEN round({rx("t", PASSIVE)} / len(sents), 3) ELSE 0.0 END::DOUBLE AS passive_ratio,
    CASE WHEN len(ws) > 0 THEN round(len(list_distinct(ws)) / len(ws), 3) ELSE 0.0 END::DOUBLE AS ttr,
    {per1k(rx("t", COLON))} AS colon_lists_1k FROM c)"""


def detect(source: str = "documents", keep: str = "doc_id, lang, source, text") -> str:
    scores = ", ".join(f"{norm(k, g, b)} AS s_{k}" for k, (g, b) in L.DETECT_BANDS.items())
    total = " + ".join(f"round(s_{k}, 1) * {w}::DOUBLE" for k, w in L.DETECT_WEIGHTS.items())
    passed = " AND ".join(f"s_{k} >= {L.DETECT_TARGET}" for k in L.DETECT_BANDS)
    return f"{english(source, keep)}, s AS (SELECT *, {scores} FROM f), d AS (SELECT *, 0.0::DOUBLE + {total} AS total, {passed} AS all_passed FROM s)"


def burstiness() -> str:
    return f"""{english()}, g AS (SELECT *, len(list_filter(list_transform({sents("t", ".!?।॥")}, lambda s: {wc("s")}), lambda n: n > 1)) < 5 AS short, CASE WHEN len(paras) > 3 THEN {cv("paras")} ELSE 0.40::DOUBLE END AS p_cv FROM f)
SELECT doc_id, CASE WHEN short THEN 75.0 ELSE round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.50::DOUBLE * {norm("sent_cv", 0.60, 0.25)} + 0.28::DOUBLE * {norm("p_cv", 0.45, 0.10)} + 0.22::DOUBLE * {norm("rep_open", 0.0, 0.20)})), 1) END::DOUBLE AS burstiness FROM g"""


ATTRIBUTES = r"""(?:[ \t\r\n/](?:"[^"]*"|''[^'']*''|[^>"''])*)?"""
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def decode(t: str) -> str:
    names_, chars = names(list(NAMED)), names(list(NAMED.values()))
    name, rest = (f"regexp_extract(q, '(?s)^(#[xX][0-9a-fA-F]{{1,6}}|#[0-9]{{1,7}}|[A-Za-z][A-Za-z0-9]*);(.*)$', {i})" for i in (1, 2))
    code = f"CASE WHEN regexp_matches({name}, '^#[xX]') THEN ('0x' || substr({name}, 3))::BIGINT WHEN starts_with({name}, '#') THEN substr({name}, 2)::BIGINT END"
    point = f"CASE WHEN {code} > 0 AND {code} < 1114112 AND NOT {code} BETWEEN 55296 AND 57343 THEN chr(({code})::INT) END"
    one = f"coalesce(coalesce({chars}[list_position({names_}, {name})], {point}) || {rest}, '&' || q)"
    return f"(CASE WHEN contains({t}, '&') THEN string_split({t}, '&')[1] || array_to_string(list_transform(string_split({t}, '&')[2:], lambda q: {one}), '') ELSE {t} END)"


def clean(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'), ' ')"


def plain(t: str) -> str:
    return clean(f"replace({decode(f"regexp_replace({t}, '<[^>]*>', ' ', 'g')")}, chr(160), ' ')")


def tags(t: str, name: str) -> str:
    return f"regexp_extract_all({t}, '(?i)<{name}{ATTRIBUTES}>')"


def attribute(tag: str, name: str) -> str:
    value = f"""regexp_extract({tag}, '(?is)[ \t\r\n"''/]{name}[ \t\r\n]*=[ \t\r\n]*("[^"]*"|''[^'']*''|[^ \t\r\n"''>]+)', 1)"""
    return decode(f"""regexp_replace({value}, '^["'']|["'']$', '', 'g')""")


def meta(t: str, name: str, by: str = "name") -> str:
    return clean(f"""coalesce({attribute(f"list_filter({tags(t, 'meta')}, lambda m: lower({attribute('m', by)}) = '{name}')[1]", "content")}, '')""")


NOISE = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
FURNITURE = r"(?is)<nav[^>]*>.*?</nav>|<footer[^>]*>.*?(</footer>|$)|<header[^>]*>.*?</header>|<aside[^>]*>.*?</aside>|<form[^>]*>.*?</form>|<head[^>]*>.*?</head>"


def host(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"


def pages() -> str:
    """CTEs up to `p`: page rows."""
    return f"""WITH p0 AS (SELECT page_id, url, html, regexp_replace(coalesce(html, ''), '{NOISE}', '', 'g') AS h FROM pages),
p1 AS (SELECT *, regexp_replace(h, '{FURNITURE}', ' ', 'g') AS rest, {tags("h", "img")} AS imgs, {tags("h", "a")} AS tags_a FROM p0),
p2 AS (SELECT *, {plain("rest")} AS body FROM p1),
p AS (SELECT page_id, url, {plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {meta("h", "description")} AS description,
    regexp_extract(h, '(?is)<html[^>]*lang="([^"]*)"', 1) AS lang,
    list_transform(regexp_extract_all(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda x: {plain("x")}) AS h1,
    list_transform(regexp_extract_all(h, '(?is)<h2[^>]*>(.*?)</h2>', 1), lambda x: {plain("x")}) AS h2,
    {wc("body")}::BIGINT AS words, left(sha1(lower(body)), 16) AS content_hash,
    list_filter(list_transform(tags_a, lambda a: {attribute("a", "href")}), lambda x: x <> '') AS links, len(imgs) AS images,
    regexp_extract_all(coalesce(html, ''), '"@type"[ ]*:[ ]*"([^"]*)"', 1) AS schema_types FROM p2)"""


def token_set(t: str, stop: list[str], longer: int = 2, pattern: str = "[a-z0-9]+") -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({t}), '{pattern}'), lambda w: length(w) > {longer} AND NOT list_contains({names(stop)}, w)))"
