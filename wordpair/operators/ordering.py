"""Global dense row numbers without a single-partition window.

``dense_index`` numbers rows 0..N-1 in a total order.  The frame is range
partitioned and sorted (a hot key is split over many partitions by the range
bounds), each row gets ``monotonically_increasing_id`` (partition id in the
high bits, row number inside the partition in the low 33 bits), and the
per-partition row counts -- one row per partition, so bounded by the
partition count -- are turned into offsets and broadcast back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordpair.session import materialize

LOW_BITS = 33
LOW_MASK = (1 << LOW_BITS) - 1


def dense_index(df: DataFrame, order_cols, name: str = "idx", start: int = 0,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start + rank of the row in ``order_cols`` (must be unique)."""
    order_cols = list(order_cols)
    if num_partitions:
        s = df.repartitionByRange(num_partitions, *order_cols).sortWithinPartitions(*order_cols)
    else:
        s = df.orderBy(*order_cols)
    s = s.withColumn("_mid", F.monotonically_increasing_id())
    # Both passes below must see the same partitioning: store the numbered frame.
    s = materialize(s, "sorted")
    pid = F.shiftright(F.col("_mid"), LOW_BITS)
    counts = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = (s.join(F.broadcast(offs), pid == F.col("_pid"))
             .withColumn(name, F.col("_off") + (F.col("_mid").bitwiseAND(F.lit(LOW_MASK)))
                         + F.lit(start))
             .drop("_mid", "_pid", "_off"))
    return out
