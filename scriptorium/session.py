"""Session settings, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine is tested with. Sizes of partitions belong to the cluster and are not set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(name: str = "scriptorium", cores: str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = SETTINGS | {
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false",
    } | settings
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a scan that a core takes as one part.
PART = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt over all cores where it has fewer files than these, and little for each: for narrow, heavy
    work on small inputs. A table of a cluster's size is left as it is.

    Decided by the plan's statistics and the list of files, so that nothing runs; meant for scans, before they are joined.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * PART and len(df.inputFiles()) < cores else df


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="scriptorium-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
