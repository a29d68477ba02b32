"""Adding up partial results with a bounded fan-in.

Tasks leave one row a key each (an array, a matrix).  A plain ``groupBy`` would put
as many of them in one group as there are tasks; here at most ``fan`` meet at a
time, in as many levels as that takes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16


def merge_tree(parts: DataFrame, keys: Sequence[str], merge: Callable[[pa.Table], pa.Table], schema: str,
               fan: int = FAN_IN) -> DataFrame:
    """``parts(*keys, ..., part)`` -> one row a key, without ``part``.

    ``part`` numbers a key's rows (the task that left them) and ``parts`` must be
    stored, as it is read twice.  ``merge`` makes one row of up to ``fan`` rows of a
    key, with the columns of ``schema`` (all but ``part``); it sees single rows too.
    """
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return parts.drop("part")

    def one(table: pa.Table) -> pa.Table:
        return merge(table.drop_columns(["part"])).append_column("part", table.column("part")[:1])

    level = parts
    while True:
        level = (level.withColumn("part", F.expr(f"cast(part div {fan} as long)"))
                 .groupBy(*keys, "part").applyInArrow(one, schema + ", part long"))
        last //= fan
        if not last:
            return level.drop("part")
