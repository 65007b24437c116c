"""Keyed state in streams: a throttle that successes reset, and a cache whose entries expire. Both follow event time.

Rows wait in state until the watermark has passed them, and are then taken in the order of their times, so that the results
don't depend on how rows came to be in micro-batches: they equal those of the batch operators in corpus.py. Rows later than
the watermark go, as Spark defines. What a key holds leaves its state when its window or its time to live is over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state needs, while a query is started; the session's own setting comes back afterwards."""
    held = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if held is None else spark.conf.set(_PROVIDER, held)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them; then settle() takes those of each instant, in order."""

    #: Fields of a row that wait with its time, in DDL.
    fields = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"_at long{', ' if self.fields else ''}{self.fields}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in self.fields.split(", ")] if self.fields else []
        for r in rows:
            self.waiting.appendValue((r["_at"], *(r[n] for n in names)))
            self.handle.registerTimer(r["_at"] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a timer's millisecond is met by the watermark, and rows of it may still come: only what stands before it is whole
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[0])
        due = [tuple(r) for r in rows if r[0] < until]
        if due:
            rest = [tuple(r) for r in rows[len(due) :]]
            self.waiting.put(rest) if rest else self.waiting.clear()
        yield from self.settle(key, due, until)

    def settle(self, key, due: list[tuple], until: int) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Throttle(InOrder):
    """State: the failures of the trailing window since the last reset. At one instant failures come before a reset."""

    fields = "_id long, _failed boolean"

    def __init__(self, seconds: int, attempts: int):
        self.window, self.attempts = seconds * 1_000_000, attempts

    def init(self, handle) -> None:
        super().init(handle)
        self.failures = handle.getListState("failures", "_at long")

    def settle(self, key, due, until):
        held = [r[0] for r in self.failures.get()]
        i = 0
        while i < len(due):
            at = due[i][0]
            now = [r for r in due[i:] if r[0] == at]
            i += len(now)
            failed = [r for r in now if r[2]]
            held = [t for t in held if t > at - self.window] + [at] * len(failed)
            for r in failed:
                yield Row(key=key[0], id=r[1], at=at, recent=len(held), locked=len(held) >= self.attempts)
            if len(failed) < len(now):
                held = []
        held = [t for t in held if t > until - self.window]
        if held:
            self.failures.put([(t,) for t in held])
            self.handle.registerTimer((held[-1] + self.window) // 1000 + 1)  # then nothing is left of the key
        elif self.failures.exists():
            self.failures.clear()


class Cache(InOrder):
    """State: a key's latest entry, until its time to live is over. Each entry gives a row, and each that expires another."""

    fields = "_value string"

    def __init__(self, seconds: int):
        self.lives = seconds * 1_000_000

    def init(self, handle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "_at long, _value string")

    def settle(self, key, due, until):
        held = self.entry.get()
        for at, value in sorted(due, key=lambda r: (r[0], r[1] or "")):
            if held and held[0] + self.lives <= at:
                yield Row(key=key[0], at=held[0] + self.lives, value=held[1], event="expired")
            held = (at, value)
            yield Row(key=key[0], at=at, value=value, event="written")
        if held and held[0] + self.lives < until:
            yield Row(key=key[0], at=held[0] + self.lives, value=held[1], event="expired")
            held = None
        if held:
            self.entry.update(tuple(held))
            self.handle.registerTimer((held[0] + self.lives) // 1000 + 1)
        elif self.entry.exists():
            self.entry.clear()


def _stateful(stream: DataFrame, by: str, at: str, delay: str, columns: list, processor: StatefulProcessor, output: str) -> DataFrame:
    micros = F.unix_micros(F.col(at).cast("timestamp")).alias("_at")
    rows = stream.select(F.col(by).alias("_key"), F.col(at).cast("timestamp").alias("_time"), micros, *columns).filter("_at is not null").withWatermark("_time", delay)
    return rows.groupBy("_key").transformWithState(processor, outputStructType=output, outputMode="Append", timeMode="EventTime")


def throttled(stream: DataFrame, by: str, at: str, id: str, failed, seconds: int, attempts: int, delay: str = "1 hour") -> DataFrame:
    """key, id, at (microseconds), recent, locked of each failure, as corpus.throttled(reset=) gives them. failed: a column,
    false where a row resets the key. Rows without a time go."""
    kind = dict(stream.dtypes)[by]
    columns = [F.col(id).cast("long").alias("_id"), F.coalesce(failed, F.lit(False)).alias("_failed")]
    return _stateful(stream, by, at, delay, columns, Throttle(seconds, attempts), f"key {kind}, id long, at long, recent long, locked boolean")


def cached(stream: DataFrame, by: str, at: str, value: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """key, at (microseconds), value, event: entries as they are written and as they expire. What is written and not expired
    at an instant is what corpus.fresh() keeps of the keys' latest entries."""
    kind = dict(stream.dtypes)[by]
    return _stateful(stream, by, at, delay, [F.col(value).cast("string").alias("_value")], Cache(seconds), f"key {kind}, at long, value string, event string")


def first_seen(stream: DataFrame, by: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key to arrive; repeats within the delay go, later rows than the watermark too.

    The rows of a crawl: what was fetched again by a run that resumed, or by two runs at once, stands once.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(by)


def drained(rows: DataFrame, path: str, checkpoint: str, start: Callable | None = None) -> DataFrame:
    """Runs a stream over all that is there, appending to files at path, and gives them as a table."""
    spark = rows.sparkSession
    with keyed_state(spark):
        writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        query = (start or (lambda w: w.start()))(writer)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
