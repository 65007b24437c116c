"""Null, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator that keeps columns
and for the pipeline's filtering stages."""

import random

import corpus_pipeline
import pytest

from scriptorium.llm import mixing, radixdedup, simhash, weaksup
from scriptorium.llm.common import with_arrow

#: Names that the operators use inside, besides those of the documents.
NAMES = ["_key", "_size", "size", "_source", "_none", "source_size", "target", "cut", "epochs", "part", "_times", "_copy", "_measures", "_a", "_b", "_id", "_hash", "_spans", "_node", "_print", "_shard", "_s", "_rows", "component_id", "c0", "c1", "text_", "place", "Text "]
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    words = ["the", "of", "and", "river", "boat", "house", "green", "small", "walks", "under", "night"]
    return "\n".join(" ".join(rng.choice(words) + str(rng.randrange(9) or "") for _ in range(12)) + "." for _ in range(n // 12))


def rows(rng):
    own = [(i, prose(rng, 60), "en", "ab"[i % 2], 1) for i in range(24)]
    own += [(100, own[0][1], "en", None, 1), (0, own[0][1], "en", "a", 1), (101, None, None, None, None), (102, "", "en", "a", 0), (None, prose(rng, 48), "en", "a", 1), (None, None, None, None, None)]
    return own + [(103, prose(rng, 30_000), "en", "b", 1)]


@pytest.mark.parametrize("stage", [weaksup.apply, simhash.dedupe, simhash.dedupe_similar, lambda d: radixdedup.apply(d, 200), mixing.apply])
def test_columns_pass_whatever_their_names(spark, frame, stage):
    rng = random.Random(3)
    given = [(*r, *(f"{n}{i}" for n in range(len(NAMES)))) for i, r in enumerate(rows(rng))]
    docs = frame(given, BASE + "".join(f", `{n}` string" for n in NAMES))
    out = stage(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    by_last = {r[-1]: r for r in given}
    got = out.collect()
    assert got
    for r in got:
        want = by_last[r[-1]]
        assert tuple(r)[5:] == want[5:] and (r.doc_id, r.lang, r.source) == (want[0], want[2], want[3])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, frame, stage):
    assert stage(spark, frame([]), "").count() == 0


def test_stages_of_odd_rows(spark, frame):
    docs = frame(rows(random.Random(4)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "pack":
            assert out.count() > 0
            break
        docs = frame([tuple(r) for r in out.collect()])
        ids = [r.doc_id for r in docs.collect()]
        assert 103 in ids and 101 not in ids and 102 not in ids  # texts without words go, long ones stay
        if name != "quality":
            assert not {0, 100} <= set(ids) or name == "mix"


def test_arrow_batches_are_cut(frame):
    docs = frame([(i, "x" * i, "en", "a", 1) for i in range(1200)])
    out = with_arrow(docs.coalesce(1), "text", "n long, most long", lambda texts: [[len(t) for t in texts], [len(texts)] * len(texts)], drop=True)
    got = out.collect()
    assert [r.n for r in got] == list(range(1200)) and max(r.most for r in got) <= 500 and "text" not in out.columns
