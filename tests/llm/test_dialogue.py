import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def brute(rows):
    """The least (cost, audit) of all edits with two insertions at most at any place."""
    found = []

    def go(i, roles, cost, audit, inserted):
        if not re.fullmatch("s?u?(au)*a?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if fault not in (dialogue.BLANK, dialogue.DUPLICATE):
                more = 5 * (fault == dialogue.TRUNCATED)
                go(i + 1, roles + (initial or "?"), cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.integers(0, 3)), max_size=4))
def test_cheapest_equals_all_edits(rows):
    assert dialogue.cheapest(rows) == brute(rows)


def test_long_passes_put_aside_what_is_shared():
    rng = random.Random(1)
    rows = [(rng.choice("suauaua"), rng.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(2000)]
    best = [(0, ""), None, None, None]
    best = dialogue.closed(best)
    for r in rows:
        best = dialogue.step(best, *r)
    assert dialogue.cheapest(rows) == min(best[0], best[3])
    assert dialogue.cheapest([("u", dialogue.BLANK)] * 500) == (1000, "D" * 500)


def repaired(convs):
    """What the query returns of each conversation, by plain Python."""
    groups = {}
    for c, t, r, x in convs:
        own = groups.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, r, x in rows:
            end = x.rstrip(SPACE)[-1:]
            faults.append(1 if not end else 2 if (r, x) in seen else 3 if end not in ".!?" else 0)
            seen.add((r, x))
        turns = {t for t, *_ in rows if t is not None}
        cost, audit = dialogue.cheapest([(r[:1], f) for (_, r, _), f in zip(rows, faults)])
        lines, state, rest = [], 0, iter(rows)
        for e in audit:
            _, r, x = next(rest) if e != "I" else (None, None, "")
            if e != "D":
                state = dialogue.KEEP[r[0]][state] if e == "K" else dialogue.NEXT[state]
                lines.append(f"{r if e == 'K' else dialogue.ROLE[state]}:{x}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, *(faults.count(f) for f in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(rng):
    rows = []
    for c in range(40):
        for t in range(rng.choice((1, 3, 8, 30))):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", None, "", "tool"))
            rows.append((c, t * rng.choice((1, 1, 1, 2)) + 100 * t, role, rng.choice(("Yes.", "No!", "cut", "", "  \n", None, "Long. " * 50, "a?\r\n", "é. \x0b"))))
    for t in range(900):  # a third of all rows in one conversation, over several ranges
        rows.append((77, t, ("user", "assistant")[t % 2] if t % 7 else "user", f"{t} {rng.choice(('done.', 'cut', 'done.'))}" if t % 5 else "same."))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yo."), (None, 2, "assistant", "Yo."), (91, None, "user", "Same."), (91, None, "user", "Same."), (92, 5, "user", "x." * 200_000), (92, 6, "assistant", "x" * 300_000)]
    rows += [(c, t, "user", "Alone.") for c in range(200, 300) for t in (0,)]  # some lose all their rows
    return rows


def test_query_equals_plain_python(spark, tmp_path):
    from scriptorium.llm import queries

    rows = made(random.Random(5))
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", _range int, audit string, _seq string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {**repaired(rows)} and len(got) == len({r[0] for r in rows})
    gone = [r for r in got if not r.audit]
    assert gone and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and r.cost == 0 for r in gone)


def test_rows_are_in_order_and_follow_the_grammar(spark):
    rows = made(random.Random(6))
    found = dialogue.repair(spark.createDataFrame(rows, SCHEMA))
    texts = {}
    for r in sorted(found.rows.collect(), key=lambda r: (str(r.conv_id), r._range, r._pos)):
        texts.setdefault(r.conv_id, []).append(r)
    for own in texts.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        kept = [r.turn for r in own if r.turn is not None]
        assert kept == sorted(kept) and all(r.text == "" for r in own if r.edit == "I")
    audits = {r.conv_id: r.audit for r in found.summary.collect()}
    assert all("".join(r.edit for r in texts.get(c, [])) == a.replace("D", "") for c, a in audits.items())
    assert len({r._range for r in texts[77]}) > 1


def test_empty_table(spark):
    found = dialogue.repair(dialogue.damaged(spark.createDataFrame([], SCHEMA)))
    assert found.summary.count() == 0 and found.rows.count() == 0 and dialogue.digests(found.rows).count() == 0
