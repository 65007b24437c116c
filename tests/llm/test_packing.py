import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest_llm import doc
from scriptorium.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\xa0 aZé'ß中9½_-.,s<|>🙂"), max_size=60))
def test_encoder_equals_tokenizer(text):
    encoder = packing._encoder(PATH)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_token_string():
    encoder = packing._encoder(PATH)
    assert np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u4").tolist() == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_plan_holds_every_piece_and_is_tight():
    rng = random.Random(1)
    for capacity, most, n in ((1024, 1024, 5000), (100, 60, 3000), (10, 10, 50), (1024, 30, 400), (1024, 700, 1)):
        counts = {}
        for _ in range(n):
            x = min(most, max(1, int(rng.lognormvariate(np.log(most / 4), 0.9))))
            counts[x] = counts.get(x, 0) + 1
        kinds = packing.plan(counts, capacity)
        placed = {}
        for content, times in kinds:
            assert times > 0 and sum(a * b for a, b in content) <= capacity
            for a, b in content:
                placed[a] = placed.get(a, 0) + b * times
        assert placed == counts
        used, least = sum(t for _, t in kinds), -(-sum(a * b for a, b in counts.items()) // capacity)
        assert used <= least * 1.02 + 1 or max(counts) > capacity // 2


def test_pack(spark, frame):
    rng = random.Random(2)
    rows = [doc(i, " ".join("w%d" % rng.randrange(99) for _ in range(rng.choice((3, 30, 300, 1200))))) for i in range(80)]
    rows += [doc(5, rows[5][1])] * 2 + [doc(None, None), doc(200, ""), doc(201, "x " * 5000)]
    got = packing.pack(frame(rows), PATH, ids=True).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x != x or x is None else int(x) for x in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 2
    whole = packing.sequences(packing.pack(frame(rows), PATH, ids=True)).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole) and sum(r.length for r in whole) == got.length.sum()
    assert packing.pack(frame([]), PATH).count() == 0
