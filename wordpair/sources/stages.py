"""Stage tables: pipeline artifacts as parquet folders (S4-S8), and a store that
publishes the tables of a stage together.

A published stage is a version: every table in a folder of its own that nothing ever
writes again, then one manifest with the tables' folders, the settings, what was put
in and the versions it was built on.  The manifest is what readers look for, so a
run that breaks off anywhere leaves the version before it in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.session import discard, hadoop_fs


def write_stage(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def load_stage(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def stage_exists(spark: SparkSession, path: str) -> bool:
    """A stage is complete when its ``_SUCCESS`` marker exists."""
    fs, p = hadoop_fs(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(p))


def numbered(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders ``<kind>=<number>`` under ``path``, complete or not."""
    fs, p = hadoop_fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def fingerprint(df: DataFrame) -> str:
    """What a frame reads: its files with sizes and times, or, where it has none, the
    number of rows and the sum of their hashes; and its columns."""
    spark, columns = df.sparkSession, str(df.dtypes)
    files = sorted(df.inputFiles())
    if files:
        found = []
        for f in files:
            fs, p = hadoop_fs(spark, f)
            s = fs.getFileStatus(p)
            found.append([f, s.getLen(), s.getModificationTime()])
        return json.dumps([columns, found])
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 40))).alias("h")).first()
    return json.dumps([columns, row["n"], row["h"]])


class StageStore:
    """The stages of one output folder."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def _manifests(self, stage: str) -> str:
        return f"{self.out}/_manifests/{stage}"

    def current(self, stage: str) -> dict | None:
        """The manifest of the stage's newest complete version."""
        for v in reversed(numbered(self.spark, self._manifests(stage), "v")):
            path = f"{self._manifests(stage)}/v={v}"
            if stage_exists(self.spark, path):
                return json.loads(load_stage(self.spark, path, "manifest string").first()[0])
        return None

    def publish(self, stage: str, tables: dict[str, DataFrame], **facts) -> dict:
        """Store the tables and then their manifest, as the stage's next version;
        versions before it are deleted after that."""
        old = {n: numbered(self.spark, f"{self.out}/{n}", "v") for n in tables}
        done = numbered(self.spark, self._manifests(stage), "v")
        v = 1 + max([0, *done, *(x for vs in old.values() for x in vs)])
        paths = {n: write_stage(df, f"{self.out}/{n}/v={v}", "errorifexists") for n, df in tables.items()}
        manifest = {"version": v, "tables": paths, **facts}
        write_stage(self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1),
                    f"{self._manifests(stage)}/v={v}", "errorifexists")
        for x in done:
            discard(self.spark, f"{self._manifests(stage)}/v={x}")
        for n, vs in old.items():
            for x in vs:
                discard(self.spark, f"{self.out}/{n}/v={x}")
        return manifest

    def load(self, manifest: dict) -> dict[str, DataFrame]:
        return {n: load_stage(self.spark, p) for n, p in manifest["tables"].items()}
