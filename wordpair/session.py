"""Session construction and the checkpoint folder."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between two collections of the driver's garbage.
SWEEP_SECONDS = 5.0
_swept = [0.0]


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "wordpair", driver_memory: str = "8g") -> SparkSession:
    """A session tuned for the operators in this package.

    AQE is on: it coalesces small shuffles, turns joins against small
    runtime-measured sides into broadcast joins, and splits skewed join
    partitions.  The UI is off (no server).
    """
    b = (SparkSession.builder.appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", driver_memory))
    if master:
        b = b.master(master)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The reliable checkpoint folder the cluster names, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    try:
        return spark.conf.get("spark.checkpoint.dir", None) or None
    except Exception:  # pragma: no cover - conf lookup differences
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured ``spark.checkpoint.dir``.

    Without one a local master gets a fresh scratch folder; any other master is
    an error, since executors do not see the driver's local folders."""
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="wordpair-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wordpair-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the checkpoint folder and read back.

    Cuts the lineage like ``checkpoint()``, keeps statistics and column pruning,
    and holds no executor memory or disk; every later read sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    w = df.write.partitionBy(partition_by) if partition_by else df.write
    w.option("compression", "zstd").parquet(path)
    sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage, now and then.  Spark deletes the shuffle files
    of a job that is over once the driver has collected its plan; a driver with little
    garbage would leave those of every step on the executors' disks until the end."""
    if time.monotonic() - _swept[0] >= SWEEP_SECONDS:
        spark.sparkContext._jvm.java.lang.System.gc()
        _swept[0] = time.monotonic()


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is a table that ``materialize`` returned, which is cheap to read again."""
    return getattr(df, "_scratch", None) is not None


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned; nothing reads it
    any more.  Any other frame is left alone."""
    if is_stored(df):
        discard(df.sparkSession, df._scratch)


def hadoop_fs(spark: SparkSession, path: str):
    """``(file system, path)`` of the JVM for a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


class Bucketed:
    """A table stored by buckets of a key, so that grouping by it needs no exchange.

    A task of the writing job leaves one file for each bucket it has rows of; readers
    take a bucket's files in one task.  The key must be an int of ``bucket_keys``."""

    def __init__(self, df: DataFrame, path: str, key: str, buckets: int, partition_by: str | None = None):
        self.spark, self.path = df.sparkSession, path
        self.name = "wordpair_" + uuid.uuid4().hex
        w = df.write.format("parquet").option("path", path).bucketBy(buckets, key)
        (w.partitionBy(partition_by) if partition_by else w).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def bucket_keys(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket the least int that falls in it, so that a group has a bucket of
    its own (``buckets`` numbers come to the driver)."""
    tried = spark.range(64 * buckets + 256).select(F.col("id").cast("int").alias("key"))
    of = F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket")
    rows = tried.groupBy(of).agg(F.min("key").alias("key")).collect()
    keys = {r["bucket"]: r["key"] for r in rows}
    if len(keys) != buckets:   # 64 a bucket leave none empty, but for a chance below e**-64 each
        raise RuntimeError("a bucket has no key")
    return [keys[b] for b in range(buckets)]
