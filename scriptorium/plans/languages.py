"""Queries by language: each document with an opening in one of the target languages, so that every list is met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scripts
from ..functions import text as T
from ..operators import features, integrity, performance, scoring
from ..session import spread, table
from ..sources import html, site_files
from . import drafts
from . import sql as S
from .catalog import _SLUG, documents, query

#: Literal Hindi texts besides: plain prose, calques and spaced stops, mixed script, forms of address, mechanics, none.
HINDI = [
    (-1, "सुबह की हवा ठंडी थी। लोग धीरे चल रहे थे। बच्चे मैदान में खेल रहे थे।\nदोपहर तक धूप तेज हो गई।"),
    (-2, "यह रोग के रूप में जाना जाता है , जो लोगों के द्वारा फैलता है । इसके अलावा , यह जोर से बढ़ता है ।"),
    (-3, "The report अच्छा है but mostly English words stand here - इस प्रकार"),
    (-4, "आप आइए और आपको बताएँ। तुम भी आओ। तू क्या करेगा। तेरा काम। एवं तथा हेतु"),
    (-5, "बार - बार  कहा,फिर भी नहीं माना। जिसमें लोग जोखिम लेते हैं।"),
    (-6, ""),
]


def opening(code: str) -> str:
    """Connectives, a calque, forms of address and an over-formal word of a language, with a verb at the end."""
    forms = L.HONORIFICS[code]
    said = f"{forms['formal'][0]} {forms['formal'][-1]} {forms['formal'][0]} {forms['informal'][0]}"
    return f"{L.CONNECTIVES[code][0]} , {L.CALQUES[code][0]} {said} {L.FORMAL[code][0]} - {L.VERB_ENDINGS[code][0]}। {L.CONNECTIVES[code][0]} {L.CONNECTIVES[code][0]}  {L.VERB_ENDINGS[code][1]}. "


CODES = [x["code"] for x in L.LANGUAGES]
OPENINGS = [opening(c) for c in CODES]


def texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, text."""
    at = (F.col("doc_id") % len(CODES) + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), at)
    rows = documents(spark, d).select("doc_id", pick(CODES).alias("lang"), F.concat(pick(OPENINGS), F.coalesce("text", F.lit(""))).alias("text"))
    literal = F.array(*(F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit("hi").alias("lang"), F.lit(t).alias("text")) for i, t in HINDI))
    return spread(rows.unionByName(spark.range(1).select(F.inline(literal))))


_TEXTS = f"""h AS (SELECT doc_id, {S.names(CODES)}[(doc_id % {len(CODES)} + 1)::INT] AS lang, {S.names(OPENINGS)}[(doc_id % {len(CODES)} + 1)::INT] || coalesce(text, '') AS text FROM documents
UNION ALL SELECT id, 'hi', t FROM (VALUES {", ".join(f"({i}, {S.quoted(t)})" for i, t in HINDI)}) v(id, t))"""


def _lexicon() -> str:
    def row(x: dict) -> str:
        c = x["code"]
        first, last = L.SCRIPTS[x["script"]]
        lists = [L.VERB_ENDINGS[c], L.CONNECTIVES[c], L.CALQUES[c], L.FORMAL[c], *(L.HONORIFICS[c][level] for level in scoring.LEVELS)]
        return f"('{c}', '{x['script']}', {first}, {last}, {', '.join(S.names(v) + '::VARCHAR[]' for v in lists)})"

    return f"lex(code, script, lo, hi, verbs, conns, calques, formals, forms_0, forms_1, forms_2) AS (VALUES {', '.join(map(row, L.LANGUAGES))})"


def _listed(t: str, phrases: str) -> str:
    return f"coalesce(list_sum(list_transform({phrases}, lambda q: (length({t}) - length(replace({t}, q, ''))) // length(q))), 0)"


def _indic() -> str:
    word = r"[\p{L}\p{N}_]"
    relative = " + ".join(S.rx("t", rf"(^|[^\p{{L}}\p{{N}}_]){w}{word}") for w in L.HINDI_RELATIVES)
    quotes = " ,.।॥!?:;" + chr(34) + chr(39) + "()"
    ends = f"list_transform(list_filter(list_transform(sents, lambda s: {S.toks('rtrim(s, ' + S.quoted(' .।॥!?') + ')')}), lambda w: len(w) >= 4), lambda w: trim(w[len(w)], {S.quoted(quotes)}))"
    verb = "len(list_filter(ends, lambda w: len(list_filter(verbs, lambda v: ends_with(w, v))) > 0))"
    spaced, doubled, tight, matras, halants = S.rx("t", rf"{S.WS}+[,.।;:!?]"), S.rx("t", "  +"), S.rx("t", r"[,;:][^ \t\n\r\f\x0B\p{Nd}]"), S.rx("t", "[ा-ौ]{3,}"), S.rx("t", rf"्{S.WS}")
    letters = S.rx("t", r"\p{L}")
    own = "len(list_filter(regexp_extract_all(t, '\\p{L}'), lambda c: ord(c) BETWEEN lo AND hi))"
    latin = "len(list_filter(tk, lambda w: regexp_full_match(w, '[A-Za-z][A-Za-z''.-]*')))"
    return f"""WITH {_TEXTS}, {_lexicon()}, h0 AS (SELECT doc_id, lang, text, {S.strip("text")} AS t FROM h), h1 AS (SELECT *, lower(t) AS low, {S.sents("t", ".!?।॥")} AS sents, {S.toks("t")} AS tk, greatest(1, {S.wc("t")}) AS words FROM h0 JOIN lex ON code = lang), h2 AS (SELECT *, {ends} AS ends FROM h1),
hf AS (SELECT doc_id, lang, script, text, low, conns, calques, formals, forms_0, forms_1, forms_2, words::BIGINT AS words, len(sents)::BIGINT AS n_sents, CASE WHEN {letters} = 0 THEN 0.0 ELSE round({own} / {letters}, 3) END::DOUBLE AS purity, round({latin} / greatest(1, len(tk)), 3) AS latin,
CASE WHEN len(sents) > 0 THEN round(len(list_filter(sents, lambda s: right(s, 1) IN ('।', '॥'))) / len(sents), 3) ELSE 0.0 END::DOUBLE AS danda_frac,
{S.per1k(f"({spaced} + {doubled} + {tight} + {matras} + {halants})")} AS mech_1k, {S.per1k(spaced)} AS sp_punct_1k, {S.per1k(S.rx("t", f"{S.WS}-{S.WS}"))} AS hyphen_1k,
CASE WHEN len(ends) > 0 THEN round({verb} / len(ends), 3) ELSE 1.0 END::DOUBLE AS verb_final, {S.per1k(_listed("low", "calques"))} AS calque_1k, {S.per1k(_listed("low", "conns"))} AS conn_1k,
{S.per1k(_listed("low", "formals"))} AS formal_1k, {S.per1k(f"({relative})")} AS rel_1k, {S.per1k(S.hits("low", L.HINDI_PREPOSITIONS))} AS prep_calque_1k, {S.per1k(S.hits("t", [",", "،"]))} AS comma_1k FROM h2)"""


INDIC = _indic()
_OTHER = "greatest(0.0::DOUBLE, mech_1k - sp_punct_1k)"
_BLANK = f"len(list_filter(string_split(text, chr(10) || chr(10)), lambda b: {S.strip('b')} = '')) > 0"
_FOREIGN = "script <> 'Latin'"
GRAMMAR = f"""gr0 AS (SELECT *, CASE WHEN {_FOREIGN} AND purity < 0.6 THEN 1 ELSE 0 END + CASE WHEN {_BLANK} THEN 1 ELSE 0 END AS errors FROM hf),
gr AS (SELECT *, concat_ws(',', CASE WHEN {_FOREIGN} AND purity < 0.80 THEN 'mixed_script' END, CASE WHEN {_FOREIGN} AND latin > 0.18 THEN 'loanword_density' END, CASE WHEN sp_punct_1k > 4 THEN 'spaced_punctuation' END, CASE WHEN hyphen_1k > 2 THEN 'spaced_hyphen' END, CASE WHEN {_OTHER} > 6 THEN 'punctuation' END, CASE WHEN {_BLANK} THEN 'empty_block' END) AS flags,
round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.28::DOUBLE * {S.norm("purity", 0.99, 0.70)} + 0.40::DOUBLE * {S.norm("sp_punct_1k", 0.5, 25.0)} + 0.17::DOUBLE * {S.norm("hyphen_1k", 0.0, 6.0)} + 0.15::DOUBLE * {S.norm(_OTHER, 0.5, 18.0)} - 10.0::DOUBLE * errors)), 1) AS grammar FROM gr0)"""
_OVER = "len(list_filter(conns, lambda c: length(lower(text)) - length(replace(lower(text), c, '')) >= 3 * length(c))) > 0"
STYLE = f"""st AS (SELECT *, concat_ws(',', CASE WHEN prep_calque_1k > 2.5 THEN 'prep_calque' END, CASE WHEN rel_1k > 2.0 THEN 'relative_clause' END, CASE WHEN comma_1k > 45 THEN 'comma_density' END, CASE WHEN len(list_filter(calques, lambda c: contains(lower(text), c))) > 0 THEN 'calque' END, CASE WHEN {_OVER} THEN 'connective_overuse' END, CASE WHEN verb_final < 0.55 THEN 'word_order' END) AS flags,
round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.34::DOUBLE * {S.norm("prep_calque_1k", 0.4, 9.0)} + 0.22::DOUBLE * {S.norm("rel_1k", 0.4, 3.5)} + 0.20::DOUBLE * {S.norm("comma_1k", 22.0, 68.0)} + 0.14::DOUBLE * {S.norm("calque_1k", 0.0, 4.0)} + 0.10::DOUBLE * {S.norm("conn_1k", 1.2, 9.0)})), 1) AS translationese FROM hf)"""


def _said(forms: str) -> str:
    """How often the forms stand between characters that are no letters, digits or underscores."""
    part = "string_split(text, f)"
    before = f"right(CASE WHEN {part}[n] = '' AND n > 1 THEN f ELSE {part}[n] END, 1)"
    after = f"left(CASE WHEN {part}[n + 1] = '' AND n + 1 < len({part}) THEN f ELSE {part}[n + 1] END, 1)"
    one = f"len(list_filter(range(1, len({part})), lambda n: NOT regexp_matches({before}, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches({after}, '[\\p{{L}}\\p{{N}}_]')))"
    return f"coalesce(list_sum(list_transform({forms}, lambda f: {one})), 0)::BIGINT"


REGISTER = f"""rg0 AS (SELECT *, {_said("forms_0")} AS f, {_said("forms_1")} AS i, {_said("forms_2")} AS t3, greatest(1.0::DOUBLE, {S.wc("text")} / 1000.0::DOUBLE) AS kw, {_listed("lower(text)", "formals")} AS nf FROM hf),
rg1 AS (SELECT *, f + i + t3 AS total, greatest(f, i, t3) AS most, nf / kw AS per FROM rg0), rg2 AS (SELECT *, CASE WHEN total >= 4 THEN most / total ELSE 1.0 END::DOUBLE AS consistency, CASE WHEN total >= 4 THEN CASE most WHEN f THEN 'formal' WHEN i THEN 'informal' ELSE 'intimate' END END AS dominant FROM rg1),
rg AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.65::DOUBLE * {S.norm("consistency", 1.0, 0.55)} + 0.35::DOUBLE * {S.norm("per", 2.0, 18.0)})), 1) AS register,
concat_ws(',', CASE WHEN total >= 4 AND consistency < 0.85 THEN 'honorific_mix' END, CASE WHEN total >= 4 AND dominant <> 'formal' THEN 'honorific_level' END, CASE WHEN per > 9 THEN 'over_formal' END) AS flags FROM rg2)"""


def _kinds() -> Column:
    return F.array_join(F.transform("flags", lambda f: f["kind"]), ",").alias("flags")


@query(f"{INDIC} SELECT doc_id, {', '.join(features.HINDI)} FROM hf")
def d_g9_indic_features(spark, d):
    return features.indic(texts(spark, d)).select("doc_id", *features.HINDI)


@query(f"{INDIC}, {GRAMMAR} SELECT doc_id, flags, grammar FROM gr")
def e3_grammar(spark, d):
    return scoring.grammar(texts(spark, d), lang="lang").select("doc_id", _kinds(), "grammar")


@query(f"{INDIC}, {STYLE} SELECT doc_id, flags, translationese FROM st")
def e4_translationese(spark, d):
    return scoring.translationese(texts(spark, d), lang="lang").select("doc_id", _kinds(), "translationese")


@query(f"{INDIC}, {REGISTER} SELECT doc_id, register, round(consistency, 3) AS consistency, dominant, round(per, 1) AS formal_per_1k, f AS h_formal, i AS h_informal, t3 AS h_intimate, flags FROM rg")
def e5_h15_register(spark, d):
    rows = scoring.register(texts(spark, d), lang="lang")
    return rows.select("doc_id", "register", "consistency", "dominant", "formal_per_1k", "h_formal", "h_informal", "h_intimate", _kinds())


def _scores(rows: DataFrame) -> DataFrame:
    """rows with grammar, translationese, register, burstiness, and the flags of all."""
    out = scoring.grammar(rows, lang="lang").select("doc_id", "grammar", F.col("flags").alias("_g"))
    out = out.join(scoring.translationese(rows, lang="lang").select("doc_id", "translationese"), "doc_id")
    return out.join(scoring.register(rows, lang="lang").select("doc_id", "register"), "doc_id")


@query(f"{INDIC}, {GRAMMAR}, {STYLE}, {REGISTER}, bu AS (SELECT * FROM ({S.burstiness()})), hl AS (SELECT doc_id, (0.0::DOUBLE + grammar * 0.22::DOUBLE + translationese * 0.28::DOUBLE + register * 0.08::DOUBLE + burstiness * 0.14::DOUBLE) / {sum(L.COMPOSITE_WEIGHTS[k] for k in ('grammar', 'translationese', 'register', 'burstiness'))!r}::DOUBLE AS h FROM gr JOIN st USING (doc_id) JOIN rg USING (doc_id) JOIN bu USING (doc_id)) SELECT doc_id, round(round(h, 6), 1) AS hls, round(round(100.0::DOUBLE - h, 6), 1) AS ai_pct FROM hl")
def e33_renormalised(spark, d):
    rows = _scores(texts(spark, d)).join(scoring.burstiness(spread(documents(spark, d))).select("doc_id", "burstiness"), "doc_id")
    return scoring.renormalised(rows).select("doc_id", "hls", "ai_pct")


@query(
    f"""{INDIC}, {GRAMMAR}, {STYLE}, {REGISTER}, bu AS (SELECT * FROM ({S.burstiness()})), fd AS (SELECT * FROM ({drafts.PAIRS}, {drafts.FIDELITY} SELECT doc_id, fidelity, errors AS fe FROM fi)),
co AS (SELECT doc_id, 0.0::DOUBLE + fidelity * 0.20::DOUBLE + grammar * 0.22::DOUBLE + translationese * 0.28::DOUBLE + register * 0.08::DOUBLE + burstiness * 0.14::DOUBLE + coalesce(quality * 100.0::DOUBLE, 75.0::DOUBLE) * 0.08::DOUBLE AS total, fe + gr.errors = 0 AS passed
    FROM gr JOIN st USING (doc_id) JOIN rg USING (doc_id) JOIN bu USING (doc_id) JOIN fd USING (doc_id) LEFT JOIN labels USING (doc_id))
SELECT doc_id, round(round(total, 6), 1) AS human_likeness, round(round(100.0::DOUBLE - total, 6), 1) AS ai_pct, passed FROM co"""
)
def e9_g15_composite(spark, d):
    """Source, edited text and reviews meet by document; the language measures are of the texts with openings."""
    pairs = integrity.fidelity(drafts.edited_pairs(spark, d), "before", "after", L.OVERLAP_STOP, "after").select("doc_id", "fidelity", F.col("flags").alias("_f"))
    reviews = table(spark, d, "labels").select("doc_id", (F.col("quality") * 100.0).alias("score"))
    rows = _scores(texts(spark, d)).join(scoring.burstiness(spread(documents(spark, d))).select("doc_id", "burstiness"), "doc_id").join(pairs, "doc_id")
    rows = scoring.reviewed(rows, reviews, "doc_id").withColumn("flags", F.concat("_g", "_f"))
    return scoring.composite(rows).select("doc_id", "human_likeness", "ai_pct", "passed")


def _roman_sql() -> str:
    """CTEs up to `r`: titles in Latin letters, code point by code point with a look at what follows, not by patterns."""
    voiced, mute, dot = (scripts._at(x) for x in ([*scripts.CONSONANTS, *scripts.NUKTA], [*scripts.SIGNS, 0x4D, 0x3C], [0x3C]))
    known = {k: v for k, v in scripts.TABLE.items() if k >= "\x80"}
    letter = f"coalesce({S.names(list(known.values()))}[list_position({S.names(list(known))}, c[i])], c[i])"
    after = f"CASE WHEN i < len(c) AND contains({S.quoted(dot)}, c[i + 1]) THEN i + 2 ELSE i + 1 END"
    vowel = f"CASE WHEN contains({S.quoted(voiced)}, c[i]) AND NOT (({after}) <= len(c) AND contains({S.quoted(mute)}, c[{after}])) THEN 'a' ELSE '' END"
    return f"""{_TEXTS}, rc AS (SELECT doc_id, lang, list_transform(range(1, length(t) + 1), lambda i: substring(t, i, 1)) AS c FROM (SELECT doc_id, lang, string_split(text, '।')[1] AS t FROM h)),
r AS (SELECT doc_id, lang, array_to_string(list_transform(range(1, len(c) + 1), lambda i: {letter} || {vowel}), '') AS text FROM rc)"""


@query(f"WITH {_roman_sql()}, a AS (SELECT doc_id, lang, {_SLUG} AS s FROM r), b AS (SELECT doc_id, lang, CASE WHEN length(s) > 60 THEN regexp_replace(left(s, 60), '-[^-]*$', '') ELSE s END AS s FROM a) SELECT doc_id, lang, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM b")
def c21_roman_slugs(spark, d):
    """Slugs of what stands before a text's first full stop, in all scripts; tests hold the table against literals."""
    return texts(spark, d).select("doc_id", "lang", scripts.roman_slug(F.substring_index("text", "।", 1)).alias("slug"))


@query(f"{drafts.PAIRS}, {drafts._spans_sql('ep', 'before')}, ct AS (SELECT doc_id, count(*)::BIGINT AS n FROM sp_before GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_spans, true AS round_trip, coalesce(n, 0) AS n_tokens FROM ep LEFT JOIN ct USING (doc_id)")
def c22_masked(spark, d):
    """Spans are out of the text and come back: their number, and whether the text is the same again."""
    from ..functions import text as T

    pairs = drafts.edited_pairs(spark, d).select("doc_id", F.regexp_replace(T.ascii_digits(F.col("before")), integrity.ENUMERATOR, "  ").alias("before"))
    rows = integrity.unmasked(integrity.masked(pairs, "before"))
    return rows.select("doc_id", F.size("held").cast("long").alias("n_spans"), (F.col("unmasked") == F.col("before")).alias("round_trip"), T.regex_count(F.col("masked"), "⦉[0-9]+⦊").cast("long").alias("n_tokens"))


# ---------------------------------------------------------------- crawling, manifests, vitals

ROBOTS = "User-agent: *\nDisallow: /f\nAllow: /fr/\nDisallow: /de/1 # drafts\n\nUser-agent: GPTBot\nDisallow: /\nUser-agent: CCBot\nDisallow:\n"
_RULES = [("disallow", "/f"), ("allow", "/fr/"), ("disallow", "/de/1")]


@query(
    f"""WITH r(field, pre) AS (VALUES {", ".join(map(str, _RULES))}), u AS (SELECT page_id, url, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM pages WHERE page_id % 3 <> 0),
b AS (SELECT page_id, arg_max(field, length(pre) * 2 + (field = 'allow')::INT) AS field FROM u JOIN r ON starts_with(path, pre) GROUP BY page_id) SELECT u.page_id, url FROM u LEFT JOIN b USING (page_id) WHERE coalesce(field, 'allow') = 'allow'"""
)
def a11_g7_m2_to_fetch(spark, d):
    """What a crawl still asks for: not stored yet (every third page is), and let in by robots.txt."""
    pages = table(spark, d, "pages").select("page_id", "url")
    rules = site_files.robots_rules(spark.range(1).select("id", F.lit(ROBOTS).alias("robots")), "id")
    open_ = pages.join(pages.filter("page_id % 3 = 0").select("page_id"), "page_id", "left_anti")
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    return site_files.robots_allowed(open_.withColumn("path", path), rules).select("page_id", "url")


_AGENT_STATES = {"GPTBot": ("blocked", True), "CCBot": ("allowed", True)}


@query(f"SELECT page_id, agent, CASE WHEN page_id % 2 = 0 THEN state ELSE 'blocked_by_wildcard' END AS state, CASE WHEN page_id % 2 = 0 THEN explicit ELSE false END AS explicit FROM pages, (VALUES {', '.join(f'({S.quoted(a)}, {S.quoted(_AGENT_STATES.get(a, ('allowed', False))[0])}, {str(_AGENT_STATES.get(a, ('allowed', False))[1]).lower()})' for a in site_files.AGENTS)}) v(agent, state, explicit)")
def e30_crawler_access(spark, d):
    """Two robots.txt in turn: one that names two agents, one that shuts all out."""
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, ROBOTS).otherwise("User-agent: *\nDisallow: /\n").alias("robots"))
    return site_files.crawler_access(rows, "page_id")


@query(
    f"""{S.pages()}, m AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '# Site' || chr(10) || '> About' || chr(10) || '## Pages' || chr(10) || '- [a](' || url || ')' ELSE 'Site' || chr(10) || '- [a](https://x.org/1) [b](https://x.org/2)' END AS t FROM p),
n AS (SELECT page_id, t IS NOT NULL AS present, coalesce(starts_with(t, '# '), false) AS well, len(regexp_extract_all(coalesce(t, ''), '\\]\\((https?://[^)]+)\\)')) AS links FROM m)
SELECT page_id, 'manifest' AS "group", 'llms_txt' AS "check", CASE WHEN present THEN 'pass' ELSE 'warn' END AS status, 'medium' AS impact FROM n WHERE NOT present OR well UNION ALL SELECT page_id, 'manifest', 'llms_format', 'warn', 'low' FROM n WHERE present AND NOT well UNION ALL SELECT page_id, 'manifest', 'llms_links', 'warn', 'low' FROM n WHERE present AND links < 5"""
)
def e31_llms_findings(spark, d):
    i = F.col("page_id")
    text = F.when(i % 3 == 1, F.concat(F.lit("# Site\n> About\n## Pages\n- [a]("), "url", F.lit(")"))).when(i % 3 == 2, "Site\n- [a](https://x.org/1) [b](https://x.org/2)")
    rows = table(spark, d, "pages").select("page_id", text.alias("llms"))
    return site_files.llms_findings(site_files.audit_llms(rows, "page_id"), "page_id")


_METRICS = list(L.VITALS)


@query(
    f"""WITH t(metric, good, poor) AS (VALUES {", ".join(f"('{k}', {g!r}::DOUBLE, {p!r}::DOUBLE)" for k, (g, p, _) in L.VITALS.items())}), v AS (SELECT event_id, {S.names(_METRICS)}[(event_id % 6 + 1)::INT] AS metric, value * CASE WHEN event_id % 6 = 1 THEN 0.001::DOUBLE ELSE 20.0::DOUBLE END AS x FROM events)
SELECT event_id, v.metric, round(x, 6) AS value, CASE WHEN x <= good THEN 'good' WHEN x <= poor THEN 'needs work' ELSE 'poor' END AS rating FROM v JOIN t ON v.metric = t.metric"""
)
def e32_vitals(spark, d):
    """Events as measurements of the six metrics in turn."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, _METRICS)), (i % 6 + 1).cast("int")).alias("metric"), (F.col("value") * F.when(i % 6 == 1, 0.001).otherwise(20.0)).alias("x"))
    return performance.rated(rows, "metric", "x").select("event_id", "metric", T.rounded("x", 6).alias("value"), "rating")


@query("SELECT user_id, event_id AS id, round(value, 6) AS saving_ms, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::BIGINT AS k FROM events WHERE value > 100 QUALIFY k <= 8")
def e32_opportunities(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("value").alias("saving_ms"))
    return performance.opportunities(rows, "user_id").withColumn("saving_ms", T.rounded("saving_ms", 6))


@query(
    f"""WITH b AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), c AS (SELECT *, {S.tags("h", "script")} AS ss, {S.tags("h", "meta")} AS ms FROM b),
e AS (SELECT page_id, CASE WHEN starts_with(lower(url), 'https://') THEN 'pass' ELSE 'fail' END AS https, CASE WHEN strlen(h) > 250000 THEN 'warn' ELSE 'pass' END AS html_size, CASE WHEN len(list_filter(ms, lambda m: lower({S.attribute("m", "name")}) = 'viewport')) > 0 THEN 'pass' ELSE 'fail' END AS viewport,
CASE WHEN len(list_filter(ss, lambda s: {S.attribute("s", "src")} <> '' AND NOT regexp_matches(s, '(?i)[ \\t\\r\\n](async|defer)'))) > 2 THEN 'warn' ELSE 'pass' END AS render_blocking FROM c)
{" UNION ALL ".join(f"SELECT page_id, '{k}' AS " + '"check"' + f", {k} AS status FROM e" for k in ("https", "html_size", "viewport", "render_blocking"))}"""
)
def e32_page_basics(spark, d):
    return performance.basics(spread(table(spark, d, "pages")), "page_id")


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND ts <= (SELECT max(ts) FROM events)")
def m4_fresh(spark, d):
    """Entries of a cache that are not older than seven days when the last one is written."""
    from ..operators import corpus

    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return corpus.fresh(events, "ts", events.agg(F.max("ts").alias("_now")), 7 * 86_400).select("event_id", "user_id")


@query(f"{S.pages()}, a AS (SELECT page_id, {S.tags('regexp_replace(h0, ' + S.quoted(S.NOISE.replace(chr(39), chr(39) * 2)) + ', ' + S.quoted('') + ', ' + S.quoted('g') + ')', 'a')} AS ts FROM (SELECT page_id, coalesce(html, '') AS h0 FROM pages)) SELECT page_id, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(ts) AS t FROM a) WHERE {S.attribute('t', 'href')} <> '' GROUP BY page_id")
def b4_links_per_page(spark, d):
    rows = html.page_rows(spread(table(spark, d, "pages")), only=["links"])
    return rows.filter(F.size("links") > 0).select("page_id", F.size("links").cast("long").alias("n"))


@query(f"{S.pages()}, b AS (SELECT page_id, {S.host('url')} AS host FROM p) SELECT page_id, title, description, host, len(h1)::BIGINT AS n_h1 FROM p JOIN b USING (page_id)")
def b1_articles(spark, d):
    """Article rows of the pages: their h1 is the page's title in these tables."""
    rows = html.article_rows(spread(table(spark, d, "pages")), "page_id")
    joined = rows.join(html.page_rows(spread(table(spark, d, "pages")), only=["h1"]).select("page_id", F.size("h1").cast("long").alias("n_h1")), "page_id")
    return joined.select("page_id", "title", F.col("meta_description").alias("description"), html.host(F.col("source_url")).alias("host"), "n_h1")
