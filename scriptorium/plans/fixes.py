"""The fix loop over documents: a writer of fixed edits, whose answers follow from the id, so that each end of the loop is met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fixing
from ..session import spread
from . import sql as S
from .audits import _CONTENT, _ROLLED
from .catalog import documents, query
from .drafts import _GUARD

LONGER = "\nThe road is long and the day is fine." * 40
INVENTED, CLAIM, FIVE = " In 2031 it was 97 km.", " A guaranteed cure.", " It is 5 now."
VARIED = "\nYes. No. And who would have thought of it on such a day as this one, so fine and so long that nobody wished it to end at all?" * 12


def writer(rows: DataFrame, text: str, told: str, name: str) -> DataFrame:
    """By the id: mends its mistake when told, never does, changes nothing, takes all digits away, gives nothing."""
    i, t, again = F.col("doc_id"), F.col(text), F.size(told) > 0
    longer = F.concat(t, F.lit(LONGER))
    by_id = F.when(i % 5 == 0, F.when(again, longer).otherwise(F.concat(longer, F.lit(INVENTED)))).when(i % 5 == 1, F.concat(t, F.lit(INVENTED))).when(i % 5 == 2, t)
    by_id = by_id.when(i % 5 == 3, F.concat(F.regexp_replace(t, "[0-9]", ""), F.lit(LONGER))).when(i % 10 == 4, None)
    return rows.withColumn(name, by_id.otherwise(F.when(again, longer).otherwise(F.concat(longer, F.lit(CLAIM)))))


def humaniser(rows: DataFrame, text: str, told: str, name: str) -> DataFrame:
    i, t = F.col("doc_id"), F.col(text)
    return rows.withColumn(name, F.when(i % 3 == 0, F.concat(t, F.lit(FIVE))).when(i % 3 == 1, F.concat(t, F.lit(VARIED))))


def _candidate(again: bool) -> str:
    longer = f"o || {S.quoted(LONGER)}"
    mended = lambda wrong: longer if again else f"{longer} || {S.quoted(wrong)}"
    return f"""CASE WHEN doc_id % 5 = 0 THEN {mended(INVENTED)} WHEN doc_id % 5 = 1 THEN o || {S.quoted(INVENTED)} WHEN doc_id % 5 = 2 THEN o
    WHEN doc_id % 5 = 3 THEN regexp_replace(o, '[0-9]', '', 'g') || {S.quoted(LONGER)} WHEN doc_id % 10 = 4 THEN NULL ELSE {mended(CLAIM)} END"""


def _varied(c: str) -> str:
    return f"CASE doc_id % 3 WHEN 0 THEN {c} || {S.quoted(FIVE)} WHEN 1 THEN {c} || {S.quoted(VARIED)} END"


# versions of a text are numbered 10 * id + 0: itself, 1 and 2: the candidates, 3 and 4: these made less uniform;
# pairs 10 * id + 0 and 1: itself with each candidate, 2 and 3: each candidate with what became of it
FIX = f"""WITH fx AS (SELECT doc_id, o, {_candidate(False)} AS c0, {_candidate(True)} AS c1 FROM (SELECT doc_id, text AS o FROM documents)),
fh AS (SELECT *, {_varied("c0")} AS h0, {_varied("c1")} AS h1 FROM fx),
versions AS (SELECT doc_id * 10 + v AS doc_id, coalesce(text, '') AS text FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS v, unnest([o, c0, c1, h0, h1]) AS text FROM fh)),
ep AS (SELECT doc_id * 10 + v AS doc_id, before, after FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS v, unnest([o, o, c0, c1]) AS before, unnest([c0, c1, h0, h1]) AS after FROM fh)),
{_CONTENT.replace("FROM documents", "FROM versions")}, {_ROLLED}, {_GUARD},
bl AS (SELECT doc_id, list_concat(list_transform(invented, lambda x: 'invented:' || x), list_transform(missing, lambda x: 'missing_terms:' || x), list_transform(claims, lambda x: 'new_claims:' || x), CASE WHEN lost THEN ['hedge_lost'] ELSE [] END) AS blocking,
    array_to_string(list_transform(dropped, lambda x: 'dropped:' || x), ',') AS review FROM gf),
de AS (SELECT * FROM ({S.detect("versions", "doc_id, text")} SELECT doc_id, round(100.0::DOUBLE - total, 1) AS ai, all_passed AS passed FROM d)),
x0 AS (SELECT fh.*, p0.blocking AS b0, p1.blocking AS b1, CASE WHEN c0 IS NULL THEN NULL WHEN len(p0.blocking) = 0 THEN 1 WHEN len(p1.blocking) = 0 THEN 2 END AS pick FROM fh JOIN bl p0 ON p0.doc_id = fh.doc_id * 10 JOIN bl p1 ON p1.doc_id = fh.doc_id * 10 + 1),
x1 AS (SELECT x0.*, s0.score AS before, s1.score AS candidate, d1.ai AS ai1, coalesce(s1.score > s0.score, false) AS applied,
    coalesce(s1.score > s0.score AND NOT d1.passed AND CASE pick WHEN 1 THEN h0 ELSE h1 END IS NOT NULL AND len(p2.blocking) = 0 AND d2.ai <= d1.ai AND s2.score >= s1.score, false) AS humanised, d2.ai AS ai2, s2.score AS varied
    FROM x0 JOIN h s0 ON s0.doc_id = x0.doc_id * 10 LEFT JOIN h s1 ON s1.doc_id = x0.doc_id * 10 + pick LEFT JOIN de d1 ON d1.doc_id = x0.doc_id * 10 + pick
    LEFT JOIN bl p2 ON p2.doc_id = x0.doc_id * 10 + pick + 1 LEFT JOIN h s2 ON s2.doc_id = x0.doc_id * 10 + pick + 2 LEFT JOIN de d2 ON d2.doc_id = x0.doc_id * 10 + pick + 2)
SELECT x1.doc_id, applied, CASE WHEN applied THEN NULL WHEN pick IS NOT NULL THEN 'no_improvement' WHEN c0 IS NULL THEN 'pending' ELSE 'safety' END AS reason,
    CASE WHEN c0 IS NULL THEN 0 WHEN pick = 1 THEN 1 ELSE 2 END::BIGINT AS tried, before::BIGINT AS before, CASE WHEN humanised THEN varied ELSE candidate END::BIGINT AS after,
    CASE WHEN humanised THEN ai2 WHEN applied THEN ai1 END AS ai_likeness, humanised, CASE WHEN pick IS NULL AND c0 IS NOT NULL THEN array_to_string(b1, ',') ELSE '' END AS blocking, r.review,
    md5(coalesce(CASE WHEN NOT applied THEN o WHEN humanised THEN CASE pick WHEN 1 THEN h0 ELSE h1 END WHEN pick = 1 THEN c0 ELSE c1 END, '')) AS digest
FROM x1 LEFT JOIN bl r ON r.doc_id = x1.doc_id * 10 + pick - 1"""


@query(FIX)
def n7_fix_loop(spark, d):
    rows = fixing.fix(spread(documents(spark, d).select("doc_id", "text")), writer, humaniser)
    joined = {c: F.array_join(c, ",").alias(c) for c in ("blocking", "review")}
    plain = [F.col(c).cast("long").alias(c) if c in ("tried", "before", "after") else joined.get(c, F.col(c)) for c in ("doc_id", "applied", "reason", "tried", "before", "after", "ai_likeness", "humanised", "blocking", "review")]
    return rows.select(*plain, F.md5(F.coalesce("fixed", F.lit(""))).alias("digest"))
