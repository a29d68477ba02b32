"""Exact duplicate removal (built-in functions only).

Texts are compared after every run of ASCII white space became one space.
Rows are grouped by a 128-bit hash of that text *and* the text itself, so the
aggregate compares bytes inside a hash group: two texts that collide stay two
groups.  Partial aggregation leaves one row per task and distinct text before
the shuffle, so a text that a third of all rows share costs one row per task.

The rows then find their group by hash alone, which moves 24 bytes per row
instead of the text.  Hashes that hold more than one text (collisions) are
counted first; only their rows are joined on the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordpair.llm.store import columns_of, new_name, written

#: Runs of white space that count as one space.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def hash128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_fn=hash128) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the smallest id among equal texts, ``kept`` marks its row.
    A null text counts as empty.  A null id never becomes ``keep_id`` unless
    all ids of the group are null, and then ``kept`` is true for all of them.
    Rows that repeat an id and a text count each in ``group_size`` and are all
    ``kept`` if theirs is the smallest.  Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("norm"))
    rows = rows.withColumn("h", hash_fn(F.col("norm")))
    texts = (rows.groupBy("h", "norm")
             .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
             .select("h", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    texts = written(texts, "texts")
    clashing = texts.groupBy("h").count().where("count > 1").select("h")
    if clashing.isEmpty():
        found = rows.select("doc_id", "h").join(texts, "h")
    else:
        clashing = written(clashing, "clashing")
        alone = rows.select("doc_id", "h").join(clashing, "h", "left_anti").join(texts, "h")
        shared = rows.join(clashing, "h").withColumn("text_sha256", F.sha2("norm", 256))
        found = alone.unionByName(shared.select("doc_id", "h", "text_sha256")
                                  .join(texts, ["h", "text_sha256"]))
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text, that of the smallest id,
    its columns untouched.

    Of rows that repeat the same id and text one is kept.  Rows whose id is
    null are kept only where no other row has their text (one of them).
    """
    own, other = new_name("__text", docs.columns), new_name("__copies", docs.columns)
    text = F.col(f"`{text_col}`")
    g = exact_groups(docs, id_col, text_col)
    keep = (g.where("kept").groupBy(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_text"))
            .agg(F.count(F.lit(1)).alias(other)))
    keyed = docs.withColumn(own, F.sha2(normalised(text), 256)).alias("d")
    # the ids of docs and keep are told apart by alias, whatever docs' columns are called
    out = keyed.join(keep.alias("k"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.__keep_id"))
                     & (F.col(f"d.`{own}`") == F.col("k.__keep_text")), "inner")
    cols = [F.col("d.`" + c.replace("`", "``") + "`") for c in docs.columns]
    once = out.where(F.col(f"k.`{other}`") == 1).select(*cols)
    again = out.where(F.col(f"k.`{other}`") > 1).select(*cols, F.col(f"d.`{own}`"))
    again = again.dropDuplicates([id_col, own]).select(*columns_of(docs))
    return once.unionByName(again)
