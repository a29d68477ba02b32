"""Tables derived from the driver's ``embeddings`` table (FIXTURES.md part B).

All are pure DataFrame expressions over the whole table, so their size
grows with the input and an SQL engine can rebuild them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.operators.ordering import dense_index
from wordpair.sources.corpus import read_table

PAIR_OFFSETS = 5          # B7: partners id+1 .. id+5
X_MODULUS = 150           # B7: x = 1 + (7 w1 + 13 w2) % 150, values above 100 hit the clamp


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(id INT, word STRING, count BIGINT, v ARRAY<DOUBLE>)``.

    Unit-norm embeddings are rescaled by 1 + (vec_id % 7) / 4 so norms vary
    (D2 is degenerate on unit norms); count = 100000 div (vec_id + 1) + 1.
    """
    e = read_table(spark, sf, "embeddings")
    scale = F.lit(1.0) + (F.col("vec_id") % 7).cast("double") / 4.0
    return e.select((F.col("vec_id") + 1).cast("int").alias("id"),
                    F.concat(F.lit("w"), (F.col("vec_id") + 1).cast("string")).alias("word"),
                    (F.floor(F.lit(100000) / (F.col("vec_id") + 1)) + 1).cast("bigint").alias("count"),
                    F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))


def synthetic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``(w1 INT, w2 INT, x BIGINT)`` on the ids of B6."""
    v = vectors(spark, sf)
    max_id = v.agg(F.max("id")).scalar()
    p = v.select(F.col("id").alias("w1"),
                 F.explode(F.sequence(F.lit(1), F.lit(PAIR_OFFSETS))).alias("k"))
    p = p.select("w1", (F.col("w1") + F.col("k")).cast("int").alias("w2")).where(F.col("w2") <= max_id)
    return p.select("w1", "w2", (F.lit(1) + (F.col("w1") * 7 + F.col("w2") * 13) % X_MODULUS)
                    .cast("bigint").alias("x"))


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """``(t BIGINT, c ARRAY<DOUBLE>)``: every embedding as a discourse vector."""
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("t"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("c"))


def document_vectors(spark: SparkSession, sf: str, vocab: DataFrame) -> DataFrame:
    """Vectors for a vocabulary of real words: word ``id`` takes the embedding
    number (id - 1) modulo their number, scaled by 1 / (1 + id % 5)."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.count()
    v = vocab.join(e, F.pmod(F.col("id") - 1, F.lit(n)) == F.col("vec_id"))
    scale = F.lit(1.0) / (F.lit(1.0) + (F.col("id") % 5).cast("double"))
    return v.select("id", "word", "count",
                    F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))


def analogy_questions(spark: SparkSession, sf: str) -> DataFrame:
    """``(qid BIGINT, relation STRING, a, b, c, d STRING)``.

    A question is a word and the next three by id; its relation is the word's
    label.  Some cases have to be dropped or folded: words that are in no
    vocabulary (vec_id % 13 = 5 in b, vec_id % 11 = 3 in c, and the last ids),
    upper-case words (vec_id % 5 = 0 in d), repeated questions
    (vec_id % 50 = 0) and a relation of few questions (vec_id % 250 = 7).
    """
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "label")
    i = F.col("vec_id")

    def word(k):
        return F.concat(F.lit("w"), (i + k).cast("string"))
    e = e.withColumn("copy", F.explode(F.when(i % 50 == 0, F.array(F.lit(0), F.lit(1)))
                                       .otherwise(F.array(F.lit(0)))))
    return e.select((i * 2 + F.col("copy")).cast("bigint").alias("qid"),
                    F.when(i % 250 == 7, "rare").otherwise(F.col("label").cast("string")).alias("relation"),
                    word(1).alias("a"),
                    F.when(i % 13 == 5, F.lit("nowhere")).otherwise(word(2)).alias("b"),
                    F.when(i % 11 == 3, F.lit("missing")).otherwise(word(3)).alias("c"),
                    F.when(i % 5 == 0, F.upper(word(4))).otherwise(word(4)).alias("d"))


def analogy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """B9 rendered as a test file ``(file, line_no, value)``.

    By relation: a header, the questions, then lines to be skipped (three fields,
    five fields, blank).  Questions with qid % 97 = 3 come before any header.
    Lines are numbered by their rank in that order.
    """
    q = analogy_questions(spark, sf).withColumn(
        "relation", F.when(F.col("qid") % 97 == 3, F.lit("")).otherwise(F.col("relation")))
    heads = (q.select("relation").distinct().where("relation <> ''")
             .select("relation", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("qid"),
                     F.concat(F.lit(" :  "), "relation", F.lit(" ")).alias("value")))

    def body(kind, where, value):
        return q.where(where).select("relation", F.lit(kind).alias("kind"), "qid", value.alias("value"))
    rows = (heads.unionByName(body(1, "true", F.concat_ws("  ", "a", "b", "c", "d")))
            .unionByName(body(2, "qid % 29 = 0", F.concat_ws(" ", "a", "b", "c")))
            .unionByName(body(3, "qid % 31 = 0", F.concat_ws(" ", "a", "b", "c", "d", "a")))
            .unionByName(body(4, "qid % 37 = 0", F.lit("   "))))
    ranked = dense_index(rows, ["relation", "kind", "qid"], name="line_no", start=1)
    return ranked.select(F.lit("analogies").alias("file"), F.col("line_no").cast("bigint").alias("line_no"),
                         "value")
