"""Connected components by contraction, for graphs of any degree.

Each round every node points to the neighbour (or itself) that comes first in
that round's random order, edges move to what their ends point to, and loops and
repeats go.  The number of nodes with edges falls by a constant factor a round.
Minima are partial aggregates, so a node with a third of all edges is no hot
group; joins on such a node are left to the skew handling of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.llm.store import temporary, written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``node, root``: nodes of a component share a root (one
    of its nodes).  Loops and null ends are ignored; nodes without an edge are
    absent."""
    with temporary(edges.sparkSession) as keep:
        label = _components(edges)
        keep.append(label)
    return label


def _components(edges: DataFrame) -> DataFrame:
    e = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    label = written(nodes.withColumn("root", F.col("node")), "labels")
    turn = 0
    while not e.isEmpty():
        def first(c, turn=turn):
            return F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))

        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = (both.groupBy("a").agg(F.least(F.min(first("b")), F.first(first("a"))).alias("p"))
                 .select(F.col("a").alias("old"), F.col("p.node").alias("new")).where("old <> new"))
        point = written(point, "point")

        def moved(df, c, point=point):
            to = point.select(F.col("old").alias(c), F.col("new").alias("to"))
            return df.join(to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")

        label = written(moved(label, "root").select("node", "root"), "labels")
        e = written(moved(moved(e, "a"), "b").where("a <> b")
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "edges")
        turn += 1
    return label
