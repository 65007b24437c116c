"""The append-only job ledger: later lines win, in batch and in a stream alike.

A stream keeps its state in files: every micro-batch leaves the latest row of each of its keys in a folder of its own, named
by the batch's number, and now and then the folders are merged into a base. A batch that is run again writes its folder anew,
or nothing where the base holds it already, so that a replayed batch changes nothing; a folder that a killed run left without
its mark of success is not read. The state is neither in the driver's memory nor in a streaming aggregation's store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.corpus import last_wins

RECORD = (
    "key string, source string, slug string, lang string, status string, ai_pct double, fidelity double, grammar double, human_likeness double, "
    "aeo double, passes long, doc_url string, words long, error string, ts double"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's lines; torn and blank ones are skipped, missing fields are null, unknown ones go."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path).filter("key is not null")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def state(df: DataFrame, seq: str = "seq") -> DataFrame:
    return last_wins(df, "key", seq)


def pending(wanted: DataFrame, ledger_state: DataFrame) -> DataFrame:
    """Keys of wanted that aren't published yet."""
    return wanted.join(ledger_state.filter("status = 'published'"), "key", "left_anti")


class Upserts:
    """The latest row of each key, by seq and, where that is equal, by micro-batch. rows: the schema of what is upserted."""

    def __init__(self, spark: SparkSession, path: str, rows: StructType, key: str = "key", seq: str = "seq", merge_every: int = 16):
        self.spark, self.path, self.key, self.seq, self.merge_every = spark, path.rstrip("/"), key, seq, merge_every
        self.schema = StructType([*rows, StructField("_batch", LongType())])
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _whole(self, kind: str) -> list[int]:
        """The numbers of the folders that were written to their end."""
        found = self._fs.globStatus(self._path(f"{self.path}/{kind}-*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found or [])

    def _files(self) -> tuple[int, list[str]]:
        """Up to which batch the base goes, and the folders that make the state."""
        bases = self._whole("base")
        upto = bases[-1] if bases else -1
        later = [b for b in self._whole("batch") if b > upto]
        return upto, [*(f"{self.path}/base-{upto}" for _ in bases[-1:]), *(f"{self.path}/batch-{b}" for b in later)]

    def _latest(self, rows: DataFrame) -> DataFrame:
        order = F.struct(F.col(self.seq), F.col("_batch"))
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(self.key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*self.schema.names)

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def put(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch. Rows without a key go."""
        upto, _ = self._files()
        if batch <= upto:
            return
        rows = rows.filter(F.col(self.key).isNotNull()).withColumn("_batch", F.lit(batch).cast("long"))
        self._latest(rows.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        if len([b for b in self._whole("batch") if b > upto]) >= self.merge_every:
            self.merge()

    def merge(self) -> None:
        """Writes a new base; what it replaces goes once it is whole."""
        upto, files = self._files()
        later = [b for b in self._whole("batch") if b > upto]
        if not later:
            return
        self._latest(self._rows(files)).write.mode("overwrite").parquet(f"{self.path}/base-{later[-1]}")
        for kind, keep in (("base", later[-1]), ("batch", None)):
            for n in self._whole(kind):
                if n != keep and n <= later[-1]:
                    self._fs.delete(self._path(f"{self.path}/{kind}-{n}"), True)

    def state(self) -> DataFrame:
        return self._latest(self._rows(self._files()[1])).drop("_batch")


def stream_state(stream: DataFrame, path: str, checkpoint: str, key: str = "key", seq: str = "seq", merge_every: int = 16) -> tuple[Upserts, StreamingQuery]:
    """The state kept up in files at path, by a query over all that is there."""
    kept = Upserts(stream.sparkSession, path, stream.schema, key, seq, merge_every)
    query = stream.writeStream.foreachBatch(kept.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return kept, query
