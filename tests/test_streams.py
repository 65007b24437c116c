"""Streams against their batch operators, whatever the micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import corpus
from scriptorium.streaming import ledger, state

EVENTS = "/root/testdata/sf0.001/events.parquet"
START = datetime(2024, 1, 1)


def after(spark, df, folder):
    """The table's rows in six files, near in time to each other, and one row ten years later."""
    rows = df.orderBy("ts").collect()
    rng = random.Random(1)
    rows.sort(key=lambda r: r.ts + timedelta(hours=rng.random() * 5))  # out of order by five hours at most
    last = rows[-1].asDict() | {"user_id": -1, "ts": rows[-1].ts + timedelta(days=3650)}
    size = -(-len(rows) // 6)
    for part in [*(rows[i : i + size] for i in range(0, len(rows), size)), [tuple(last[c] for c in df.columns)]]:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_throttle_with_resets_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select("event_id", "user_id", "ts", "event_type").filter("event_type in ('error', 'purchase', 'click')")
    failed = F.col("event_type") != "purchase"
    rows = events.unionAll(events.filter("event_id % 50 = 0"))  # and rows of one instant
    stream = after(spark, rows, str(tmp_path / "in"))
    out = state.drained(state.throttled(stream, "user_id", "ts", "event_id", failed, 5 * 86_400, 3, "6 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
    want = corpus.throttled(rows, "user_id", "ts", 5 * 86_400, 3, reset=~failed).select("user_id", "event_id", "recent", "locked")
    got = out.filter("key >= 0").select("key", "id", "recent", "locked")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.filter("locked").count() > 5 and want.filter("recent = 1").count() > 5


def test_throttle_windows_resets_and_instants(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), True), (1, at(10), True), (1, at(59), True), (1, at(60), True), (1, at(60), False), (1, at(61), True), (2, at(0), False), (2, at(0), True), (2, at(1), None), (2, at(2), True), (3, None, True)]
    df = spark.createDataFrame(rows, "k long, at timestamp, failed boolean")
    got = corpus.throttled(df, "k", "at", 60, 3, reset=~F.col("failed")).select("k", "at", "recent", "locked").collect()
    assert sorted((r.k, (r.at - START).seconds, r.recent, r.locked) for r in got) == [(1, 0, 1, False), (1, 10, 2, False), (1, 59, 3, True), (1, 60, 3, True), (1, 61, 1, False), (2, 0, 1, False), (2, 2, 1, False)]


def test_a_cache_expires_as_the_batch_says(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).select("user_id", "ts", F.col("event_id").cast("string").alias("value"))
    rows = rows.dropDuplicates(["user_id", "ts"])
    stream = after(spark, rows, str(tmp_path / "in"))
    log = state.drained(state.cached(stream, "user_id", "ts", "value", 2 * 86_400, "6 hours"), str(tmp_path / "out"), str(tmp_path / "check")).filter("key >= 0")
    assert log.filter("event = 'written'").count() == rows.count()
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    for share in (0.2, 0.5, 0.9, 1.0):
        now = span.a + (span.b - span.a) * share
        seen = rows.filter(F.col("ts") <= F.lit(now))
        latest = corpus.last_wins(seen, "user_id", "ts")
        want = corpus.fresh(latest, "ts", spark.createDataFrame([(now,)], "_now timestamp"), 2 * 86_400)
        upto = log.filter(F.col("at") <= F.unix_micros(F.lit(now).cast("timestamp")))
        alive = corpus.last_wins(upto.withColumn("_o", F.struct("at", F.col("event") == "written")), "key", "_o").filter("event = 'written'")
        assert sorted((r.user_id, r.value) for r in want.collect()) == sorted((r.key, r.value) for r in alive.collect())
    assert log.filter("event = 'expired'").count() > 10


def test_repeated_and_late_rows_of_a_crawl(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    batches = [[("a", at(0), "1"), ("b", at(1), "1")], [("a", at(2), "2"), ("c", at(3), "1")], [("b", at(1), "1"), ("d", at(60), "1")], [("late", at(5), "1"), ("a", at(61), "3")]]
    schema, folder = "url string, fetched_at timestamp, body string", str(tmp_path / "in")
    runs = []
    for part in batches:  # each a run that resumes
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = state.drained(state.first_seen(stream, ["url"], "fetched_at", "24 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
        runs.append(sorted((r.url, r.body) for r in out.collect()))
    assert runs == [[("a", "1"), ("b", "1")], [("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], [("a", "1"), ("a", "3"), ("b", "1"), ("c", "1"), ("d", "1")]]


def rows_of(n, batch, keys=7):
    return [(f"k{(i * 5 + batch) % keys}", i + 10 * batch, f"{batch}.{i}") for i in range(n)] + [(None, 5, "no key")]


@pytest.mark.parametrize("merge_every", [2, 100])
def test_upserts_replayed_torn_and_merged(spark, tmp_path, merge_every):
    schema = spark.createDataFrame([], "key string, seq long, v string").schema
    kept = ledger.Upserts(spark, str(tmp_path / "state"), schema, merge_every=merge_every)
    assert kept.state().count() == 0
    want = {}

    def state_of():
        return {r.key: (r.seq, r.v) for r in kept.state().collect()}

    for batch in range(5):
        rows = rows_of(12 - batch, batch) + [("same", 1, f"batch {batch}")]
        frame = spark.createDataFrame(rows, schema)
        for k, seq, v in rows:
            if k is not None and seq >= want.get(k, (-1,))[0]:
                want[k] = (seq, v)
        kept.put(frame, batch)
        assert state_of() == want
        kept.put(frame, batch)  # replayed
        if merge_every == 2 and batch > 2:
            kept.put(frame.limit(0), 0)  # a batch that the base holds: nothing is done
        assert state_of() == want
    torn = tmp_path / "state" / "batch-99"
    torn.mkdir()
    (torn / "part-0.parquet").write_text("torn")
    assert state_of() == want
    kept.merge()
    assert state_of() == want


def test_a_stream_of_upserts_resumes(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "event_type")
    parts = events.randomSplit([1.0] * 5, 3)
    done = None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = part if done is None else done.unionAll(part)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        kept, query = ledger.stream_state(stream, str(tmp_path / "state"), str(tmp_path / "check"), merge_every=2)
        query.awaitTermination(120)
        want = corpus.last_wins(done, "key", "seq")
        assert sorted((r.key, r.seq, r.event_type) for r in kept.state().collect()) == sorted((r.key, r.seq, r.event_type) for r in want.collect())
