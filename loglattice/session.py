"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # beyond this many rows a LIMIT is a distributed sort, not a driver-side top-k
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


# Can only be given when the session is built.
STATIC = {
    # no Python call site per column expression: building a plan takes a fraction of the time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(name: str, cores: int, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine, with a folder of its own for what is written between steps."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **RECOMMENDED,
        **STATIC,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="loglattice-"),
        # Python workers find the package wherever the session is started
        "spark.executorEnv.PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs rely on; shuffle width is left to the cluster."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def working_root(spark: SparkSession) -> str:
    """Where all that is written between steps lies, and nothing else: `sweep` deletes in there by age."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{root.rstrip('/')}/loglattice"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's `spark.checkpoint.dir`, or beside the warehouse, which is shared as well."""
    return f"{working_root(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def sweep(spark: SparkSession, hours: float) -> int:
    """Delete working folders in which nothing has been written for `hours`; returns how many.

    A frame reads its working tables whenever it runs, so `hours` must exceed the longest job. A folder's age is that of
    its newest file, as object stores give folders no time of their own.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(working_root(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    before = (time.time() - hours * 3600) * 1000
    gone = 0
    for folder in fs.listStatus(root):
        files = fs.listFiles(folder.getPath(), True)
        newest = None
        while files.hasNext():
            newest = max(newest or 0, files.next().getModificationTime())
        if (folder.getModificationTime() if newest is None else newest) < before:
            gone += bool(fs.delete(folder.getPath(), True))
    return gone


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work all cores when the input is too small to be split that far.

    A file smaller than a split is one task. Above cores * split size the scan is wide enough by
    itself and nothing is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * split else df


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, so a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within_rows(df: DataFrame, bound: int) -> bool:
    """True when the frame provably holds at most `bound` rows; reads no more than `bound + 1`."""
    return df.limit(bound + 1).count() <= bound
