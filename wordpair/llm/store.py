"""Tables that cut lineage, in the folder all executors share, and their end.

Inside a ``temporary`` block every table that is written belongs to the block and is
deleted at its end, but for those that are kept.  Outside of one, tables stay: what
an operator returns may read them at any time later.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.session import discard

#: Folders written in each open ``temporary`` block, the innermost last.
_open: list[list[str]] = []
#: Seconds between two collections of the driver's garbage.
SWEEP_SECONDS = 5.0
_swept = [0.0]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a scratch folder of its
    own (tests); any other master is an error, as a driver's local folder is
    not visible to executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordpair-llm-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; its lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage, now and then.  Spark deletes the shuffle
    files and broadcasts of a plan once the driver has collected it; a driver with
    little garbage would leave them on the executors' disks for half an hour."""
    if time.monotonic() - _swept[0] >= SWEEP_SECONDS:
        spark.sparkContext._jvm.java.lang.System.gc()
        _swept[0] = time.monotonic()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """A block whose tables are deleted at its end, but for those that the frames put
    into the list read.  Kept tables belong to the block around it."""
    keep: list[DataFrame] = []
    _open.append([])
    try:
        yield keep
    finally:
        mine = _open.pop()
        files = [f for df in keep for f in df.inputFiles()]
        for folder in mine:
            # folders have unique names, whatever a path is spelled like
            name = "/" + folder.rsplit("/", 1)[1] + "/"
            if any(name in f for f in files):
                if _open:
                    _open[-1].append(folder)
            else:
                discard(spark, folder)
        sweep(spark)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their names, dots in them included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def new_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores before it until no column has it (in any case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name
