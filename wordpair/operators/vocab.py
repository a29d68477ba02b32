"""Vocabulary: token counts, min-count filter, frequency order, 1-based ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.operators.ordering import dense_index
from wordpair.sources.corpus import Tokens, token_slices


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: ``(seq_id, text)`` -> ``(word, n)``, one row a word and slice of texts."""
    for _, tokens, _ in token_slices(batches):
        counts = tokens.value_counts()
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])


def token_counts(tokens: Tokens | DataFrame, token_col: str = "token") -> DataFrame:
    """``(word, count)``.  Texts are split and counted in slices, so that only a slice's
    distinct words become rows."""
    if isinstance(tokens, Tokens) and tokens.texts is not None and token_col == "token":
        n = tokens.texts.mapInArrow(_count_words, "word string, n long")
        return n.groupBy("word").agg(F.sum("n").alias("count"))
    df = tokens.df if isinstance(tokens, Tokens) else tokens
    # partial (map-side) counts first, so a very frequent token costs one row per task
    return df.groupBy(F.col(token_col).alias("word")).agg(F.count(F.lit(1)).alias("count"))


def build_vocabulary(tokens: Tokens | DataFrame, min_count: int = 5,
                     max_size: int | None = None, token_col: str = "token") -> DataFrame:
    """``(id INT, word STRING, count BIGINT)``; id 1 is the most frequent word.

    Ties in count are broken by word (byte order) so ids are deterministic;
    the reference leaves that order unspecified.
    """
    kept = token_counts(tokens, token_col).where(F.col("count") >= min_count)
    order = [F.col("count").desc(), F.col("word").asc()]
    # numbered by a range sort and per-partition offsets, so that neither an
    # unlimited nor a large vocabulary meets in one task
    idx = dense_index(kept, order, name="id", start=1)
    if max_size is not None:
        idx = idx.where(F.col("id") <= int(max_size))
    return idx.select(F.col("id").cast("int").alias("id"), "word",
                      F.col("count").cast("bigint").alias("count"))


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """Number of words and total kept count (A2)."""
    return vocab.agg(F.count(F.lit(1)).alias("n_words"),
                     F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_count"))
