"""Analogy test files: ``: relation`` header lines, then ``a b c d`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordpair.session import materialize

# Whitespace as in the reference's strip/split: any Unicode space.
_WS = r"(?U)\s+"
_TRIM = r"(?U)^\s+|\s+$"

def read_analogy_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)``; line_no follows the scan order of each file."""
    return spark.read.text(path).select(F.input_file_name().alias("file"),
                                        F.monotonically_increasing_id().alias("line_no"),
                                        "value")


def parse_analogies(lines: DataFrame, file_col: str = "file", line_col: str = "line_no",
                    value_col: str = "value") -> DataFrame:
    """S3: ``(file, line_no, relation, a, b, c, d)``.

    Lines are stripped; blank lines are skipped; a line starting with ':'
    sets the relation (the stripped rest) for the lines that follow; other
    lines are kept only with exactly four whitespace-separated fields.
    Questions before any header get relation ''.

    Lines are range partitioned and sorted once, so a long file is read by many
    tasks.  A header is carried forward inside each partition; the last header of
    every partition (one row each) is carried to the partitions after it.
    """
    s = F.regexp_replace(F.col(value_col), _TRIM, "")
    is_head = F.col("s").startswith(":")
    base = (lines.select(F.col(file_col).alias("file"), F.col(line_col).alias("line_no"), s.alias("s"))
            .where(F.col("s") != ""))
    head = F.when(is_head, F.regexp_replace(F.substring("s", 2, 1 << 30), _TRIM, ""))
    rows = materialize(base.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
                       .select("file", "line_no", "s", head.alias("head"),
                               F.spark_partition_id().alias("pid")), "analogy-lines")
    last = rows.groupBy("pid").agg(
        F.max(F.when(F.col("head").isNotNull(), F.struct("file", "line_no", "head"))).alias("last"))
    # one row a partition
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    came = last.select("pid", F.last("last", ignorenulls=True).over(before).alias("came"))
    inside = Window.partitionBy("pid", "file").orderBy("line_no")
    q = (rows.withColumn("own", F.last("head", ignorenulls=True).over(inside))
         .where(F.col("head").isNull()).withColumn("f", F.split("s", _WS)).where(F.size("f") == 4)
         .join(F.broadcast(came), "pid"))
    carried = F.when(F.col("came.file") == F.col("file"), F.col("came.head"))
    return q.select("file", "line_no", F.coalesce("own", carried, F.lit("")).alias("relation"),
                    F.col("f")[0].alias("a"), F.col("f")[1].alias("b"),
                    F.col("f")[2].alias("c"), F.col("f")[3].alias("d"))
