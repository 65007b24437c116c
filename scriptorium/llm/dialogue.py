"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by a forward Viterbi pass.

Roles are to read (s?(ua)+)?, by their initials: nothing, or the system's turn if there is one, then the user's and the
assistant's in turn. The grammar has four states. A pass over a conversation's rows carries for each state the least
(cost, audit), the audit being the edits' initials; each row's layer is closed by insertions, of which two suffice. Of audits
of one cost and state none starts another (the longer one has more insertions, which cost), so the least one stays least.

A conversation may be far larger than a task should hold. Rows are dealt by ranges of (conversation, turn, ...), and a
fragment is what one range holds of a conversation. A fragment that may have begun in an earlier range is passed from each of
the four states; then fragments are chained, a row for each. Nothing but audits, a byte an edit, is gathered by conversation.

Defined results: a null role or text is one space; null turns come first, null conversations are one. Rows of one turn are
ordered by role, then by a hash of their text; equal rows are duplicates. A blank row is no duplicate, one repeated later is
blank again. A role's initial is its first character as it is, an empty role has none. An empty table gives empty results.
Long texts are cut nowhere. Only conv_id, turn, role and text are read; turns are cast to long.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from itertools import groupby, islice
from os.path import commonprefix
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered, sliced

BLANKS = " \t\n\v\f\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a state becomes with a role's initial.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What it becomes with the user's or the assistant's turn, whoever spoke.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

Best = list[tuple[int, str] | None]


def _put(best: Best, state: int, cost: int, audit: str) -> None:
    found = (cost, audit)
    if best[state] is None or found < best[state]:
        best[state] = found


def closed(best: Best) -> Best:
    """The layer with insertions: to the user's turn from any state but its own, then from there to the assistant's."""
    for p in (START, SYSTEM, ASSISTANT, USER):
        if best[p]:
            _put(best, NEXT[p], best[p][0] + INSERT_COST, best[p][1] + "I")
    return best


def step(best: Best, initial: str, fault: int) -> Best:
    """The layer after a row."""
    new: Best = [x and (x[0] + DELETE_COST, x[1] + "D") for x in best]
    if fault not in (BLANK, DUPLICATE):
        more, keeps = TRUNCATED_COST * (fault == TRUNCATED), KEEP.get(initial, {})
        for p, x in enumerate(best):
            if x:
                if p in keeps:
                    _put(new, keeps[p], x[0] + more, x[1] + "K")
                _put(new, NEXT[p], x[0] + more + REROLE_COST, x[1] + "R")
    return closed(new)


#: Rows after which what all states' audits share is put aside.
SHARED = 64


class Pass:
    """A forward pass over rows that begins in one state."""

    def __init__(self, entry: int):
        best: Best = [None] * 4
        best[entry] = (0, "")
        self.best, self.done, self.rows = closed(best), [], 0

    def add(self, initial: str, fault: int) -> None:
        best = self.best = step(self.best, initial, fault)
        self.rows += 1
        if self.rows % SHARED == 0:
            if spoken := best[ASSISTANT]:  # from there whatever follows costs as much, but for a system's turn that now goes
                if best[START] and best[START][0] > spoken[0] + DELETE_COST:
                    best[START] = None
                if best[SYSTEM] and best[SYSTEM][0] > spoken[0]:
                    best[SYSTEM] = None
            if shared := commonprefix([x[1] for x in best if x]):
                self.done.append(shared)
                self.best = [x and (x[0], x[1][len(shared) :]) for x in best]

    def ends(self) -> list[tuple[int, int, str]]:
        """State, cost, audit."""
        shared = "".join(self.done)
        return [(q, x[0], shared + x[1]) for q, x in enumerate(self.best) if x]


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of one conversation's rows (initial, fault), for use without Spark."""
    whole = Pass(START)
    for initial, fault in rows:
        whole.add(initial, fault)
    return min((cost, audit) for q, cost, audit in whole.ends() if q in (START, ASSISTANT))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults planted by a hash of conversation and turn: of twenty, one row goes, one loses its text,
    one its full stops, one stands twice, one becomes the user's. Null roles and texts become one space, as in the hash."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("_kind")).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


class Repair(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows.
    summary: DataFrame
    #: conv_id, _range, _pos, edit, turn, role, text of the repaired rows; _range and _pos give their order.
    rows: DataFrame


_ORDER = ["conv_id", "_turn", "role", "_a", "_seq"]
_FRAGMENT = (
    "_range int, _moves array<struct<entry:int,exit:int,cost:long,audit:string>>, blank long, duplicate long, truncated long, illegal long, "
    "_first string, _last string, low long, high long, turns long"
)
_PIECE = "_range int, _entry int, audit string, cost long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"


def _at_end(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def repair(conversations: DataFrame) -> Repair:
    """The cheapest repair of every conversation (conv_id, turn, role, text)."""
    scratch = Scratch(conversations.sparkSession, "dialogue")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("_turn"), said("role"), said("text"))
    rows = rows.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), "text"), "_seq": F.monotonically_increasing_id()})
    dealt = ordered(rows, _ORDER, scratch, "dealt")
    # the first of equal rows, named by its number alone: a row that stands often is no task's join
    firsts = dealt.groupBy("conv_id", "role", "_a", "_b").agg(F.min(F.struct("_turn", "_seq"))["_seq"].alias("_seq")).select("_seq", F.lit(True).alias("_is"))
    last = _at_end(F.col("text"))
    narrow = dealt.select(*_ORDER, "_range", F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), -TRUNCATED).otherwise(0).alias("_f"))
    fault = F.when(F.col("_f") == BLANK, BLANK).when(F.col("_is").isNull(), DUPLICATE).otherwise(F.abs("_f"))
    narrow = narrow.join(firsts, "_seq", "left").select("conv_id", "_range", "_turn", F.substring("role", 1, 1).alias("_i"), fault.alias("_f"), *_ORDER[2:])
    narrow = narrow.repartition("_range").sortWithinPartitions("_range", *_ORDER)
    fragments = scratch.keep(_mapped(narrow, _FRAGMENT, _passes), "fragments")
    chained = fragments.repartition("conv_id").sortWithinPartitions("conv_id", "_range")
    pieces = scratch.keep(_mapped(chained, _PIECE, _chain), "pieces")
    found = pieces.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "audit"))), lambda p: p["audit"]), "").alias("audit"),
    )
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = pieces.select("conv_id", "_range", "_entry", "audit", none("_turn", "long"), none("role", "string"), none("_a", "long"), none("_seq", "long"), none("text", "string"))
    body = dealt.select("conv_id", "_range", none("_entry", "int"), none("audit", "string"), "_turn", "role", "_a", "_seq", "text")
    # a fragment's audit, then its rows
    read = heads.unionAll(body).repartition("conv_id", "_range").sortWithinPartitions("conv_id", "_range", F.col("_entry").isNull(), *_ORDER[1:])
    edited = _mapped(read, "_range int, _pos long, edit string, turn long, role string, text string", _edits)
    return Repair(found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), edited)


def _grouped(batches, width: int):
    """Runs of rows of equal (conv_id, _range), which lead each row, as they come; a run isn't gathered."""
    rows = (row for batch in sliced(batches) for row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True))
    return groupby(rows, key=lambda r: r[:2])


def _mapped(df: DataFrame, fields: str, make: Callable) -> DataFrame:
    """The rows that make(batches) yields: the conversation, then fields."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([df.schema["conv_id"], *StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        rows = make(batches)
        while held := list(islice(rows, 500)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), arrow.types, strict=True)], names=arrow.names)

    return df.mapInArrow(run, schema)


def _passes(batches):
    """A row for each fragment: rows conv_id, _range, _turn, initial, fault in order."""
    at = None
    for (conv, part), rows in _grouped(batches, 5):
        # only a range's first conversation may have begun before it
        passes = [(e, Pass(e)) for e in (range(4) if part != at else (START,))]
        at = part
        counts, illegal, first, last, low, high, turns = [0, 0, 0, 0], 0, None, None, None, None, 0
        for _, _, turn, initial, fault in rows:
            for _, p in passes:
                p.add(initial, fault)
            counts[fault] += 1
            illegal += last is not None and last + initial not in LEGAL
            first, last = initial if first is None else first, initial
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        moves = [{"entry": e, "exit": q, "cost": cost, "audit": audit} for e, p in passes for q, cost, audit in p.ends()]
        yield (conv, part, moves, *counts[1:], illegal, first, last, low, high, turns)


def _chain(batches):
    """Each fragment's own piece of the least audit: fragments in order, from the state that the conversation starts in."""
    whole = groupby((r for _, rows in _grouped(batches, 12) for r in rows), key=lambda r: r[0])
    for conv, fragments in whole:
        best, met, last, high = {START: (0, "", None)}, [], None, None
        for n, (_, part, moves, *counts, illegal, first, end, low, top, turns) in enumerate(fragments):
            new = {}
            for m in moves:
                if before := best.get(m["entry"]):
                    found = (before[0] + m["cost"], before[1] + m["audit"])
                    if m["exit"] not in new or found < new[m["exit"]][:2]:
                        new[m["exit"]] = (*found, (before[2], m["entry"], m["cost"], m["audit"]))
            best = new
            illegal += n > 0 and last + first not in LEGAL
            turns -= low is not None and low == high
            met.append((part, *counts, illegal, low, top, turns))
            last, high = end, high if top is None else top
        chain, path = min(best[q] for q in (START, ASSISTANT) if q in best)[2], []
        while chain:
            chain, *piece = chain
            path.append(piece)
        for (part, *rest), (entry, cost, audit) in zip(met, reversed(path), strict=True):
            yield (conv, part, entry, audit, cost, *rest)


def _edits(batches):
    """The repaired rows: of each fragment its audit, then its rows in order."""
    for (conv, part), rows in _grouped(batches, 9):
        state, pos, edits = START, 0, iter(())
        for _, _, entry, audit, turn, role, _, _, text in rows:
            if entry is not None:
                state, edits = entry, iter(audit)
                continue
            for edit in edits:
                if edit == "I":
                    state = NEXT[state]
                    yield (conv, part, pos, edit, None, ROLE[state], "")
                    pos += 1
                    continue
                if edit != "D":
                    state = NEXT[state] if edit == "R" else KEEP[role[0]][state]
                    yield (conv, part, pos, edit, turn, ROLE[state] if edit == "R" else role, text)
                    pos += 1
                break
        for _ in edits:  # insertions at the end
            state = NEXT[state]
            yield (conv, part, pos, "I", None, ROLE[state], "")
            pos += 1


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired rows as role:text, joined by newlines; a hash reads row after row."""

    def made(batches):
        lines = (r for batch in sliced(batches) for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for conv, own in groupby(lines, key=lambda r: r[0]):
            digest, between = sha256(), b""
            for _, role, text in own:
                digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
            yield conv, digest.hexdigest()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_range", "_pos").select("conv_id", "role", "text")
    return _mapped(dealt, "repaired_sha256 string", made)
