"""What the operators share: word patterns, scratch tables in the shared folder, orderings without a single-task sort."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters. In Python, bytes.split() parts the same words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir; a temporary one only in local mode where none is set, as in tests."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="scriptorium-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Rows in an Arrow batch of texts; Spark's own 10,000 hold some 100 MB on either side of a worker's pipe.
BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def writing(spark: SparkSession):
    """Settings while a table is written: smaller Arrow batches of texts, unless the session has set their size itself, and
    shuffle files that go when the table is whole. The session's own settings come back afterwards."""
    held = {n: spark.conf.get(n, None) for n in (_ROWS, _FREE)}
    if held[_ROWS] == "10000":
        spark.conf.set(_ROWS, str(BATCH))
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Tables after which the driver's JVM is asked to collect its garbage.
COLLECT = 8


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    They go when the application ends (the folder is marked for deletion with the file system), or earlier with drop().
    Every scan leaves a block with its settings in each executor's memory until the driver's JVM collects the scan; an idle
    driver seldom does, so it is asked to from time to time. Shuffle files don't wait for that, see writing().
    """

    written = 0

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._fs.deleteOnExit(self._path(self.path))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with writing(self.spark):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        Scratch.written += 1
        if Scratch.written % COLLECT == 0:
            gc.collect()
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def close(self) -> None:
        self._fs.delete(self._path(self.path), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows dealt by ranges of the order, with their range in _range.

    Written, so that the sampled borders are drawn once and a lost executor can't move them.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    return scratch.keep(dealt, name)


def running(dealt: DataFrame, order: list[str], sums: dict[str, str], by: list[str] = ()) -> DataFrame:
    """Sums over all earlier rows (this one left out), of rows dealt by ordered(); within by, whose columns lead the order.

    A window sums within a range; a table with a row for each range and value of by carries the sums from range to range.
    """
    by = list(by)
    parts = dealt.groupBy(*by, "_range").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*by, "_range", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumns({k: F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in sums.items()})
    return rows.join(carried, [*by, "_range"]).withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop(*(f"_{k}" for k in sums))


def neighbours(dealt: DataFrame, order: list[str], carry: list[str], ring: bool = False) -> DataFrame:
    """Each row with the structs _before and _after: what the rows next to it in the order carry.

    Rows must come from ordered() and be distinct in the order. Past the ends stands null, or with ring the other end.
    """
    inside = Window.partitionBy("_range").orderBy(*order)
    held = F.struct(*carry)
    rows = dealt.withColumns({"_before": F.lag(held).over(inside), "_after": F.lead(held).over(inside)})
    key = F.struct(*order)
    ends = dealt.groupBy("_range").agg(F.min_by(held, key).alias("_first"), F.max_by(held, key).alias("_last"))
    ranges = Window.orderBy("_range")  # a row for each range
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("_last").over(whole) if ring else F.lit(None)
    first = F.first("_first").over(whole) if ring else F.lit(None)
    ends = ends.select("_range", F.coalesce(F.lag("_last").over(ranges), last).alias("_end_b"), F.coalesce(F.lead("_first").over(ranges), first).alias("_end_a"))
    rows = rows.join(ends, "_range")
    return rows.withColumns({"_before": F.coalesce("_before", "_end_b"), "_after": F.coalesce("_after", "_end_a")}).drop("_end_b", "_end_a")


def sliced(batches, rows: int = 500):
    """Arrow batches in parts, so that what a worker makes of them stays small whatever the session's batch size is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_arrow(df: DataFrame, text: str, fields: str, make: Callable[[list], list], drop: bool = False) -> DataFrame:
    """df with further columns (fields, in DDL) made of a column's texts, in Arrow batches; without that column if drop.

    make gets a batch's texts and returns a list of values, or an Arrow array, for each field.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    kept = [f for f in df.schema if not (drop and f.name == text)]
    schema = StructType([*kept, *new])
    names, at = [f.name for f in kept], df.columns.index(text)
    kinds = list(to_arrow_schema(new))

    def rows(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = make(batch.column(at).to_pylist())
            own = [x if isinstance(x, pa.Array) else pa.array(x, k.type) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *own], names=[*names, *(k.name for k in kinds)])

    return df.mapInArrow(rows, schema)


def renamed(df: DataFrame) -> DataFrame:
    """The table with its columns named c0, c1, ..., which clash with nothing."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
