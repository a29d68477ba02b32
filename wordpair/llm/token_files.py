"""Token ids in ORC files with row indexes and Bloom filters.

Documents are range partitioned by id and sorted, encoded in order, and written
as ORC: ids are integer run-length encoded per stripe, each stripe has a row
index and a Bloom filter on ``doc_id``.  Readers split files by stripe and skip
stripes whose statistics or filter exclude an id.

A row stores where its document starts among the ids of its *part* (the writing
task).  Parts follow each other in id order, so the global start is the sum of
the parts before (one row a part) plus the stored start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordpair.llm.word_bpe import encoder

STORED = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text",
                      stripe_bytes: int = 16 << 20) -> str:
    """Write ``docs`` to ORC files under ``path``.

    A null or empty text is the end id alone.  Null ids come last.  Rows that
    repeat an id are stored each, in the order of the input; many of them spread
    over several parts.  An empty table gives files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        start = 0
        for batch in batches:
            # few documents at a time: a text's ids take several times its bytes
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = list(enc.encode_many(some.column(1).to_pylist()))
                n = np.array([len(x) + 1 for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = np.concatenate([y for x in ids for y in (x, end)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), some.column(0),
                     pa.array(start + ends[:-1]), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"])
                start += int(ends[-1])

    place = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"), place.alias("place"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (ordered.select("doc_id", "text").mapInArrow(run, STORED).write
     .option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", "1000")
     .option("orc.stripe.size", str(stripe_bytes))
     .orc(path))
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every stored document."""
    stored = spark.read.schema(STORED).orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a writing task: bounds the frame without a partition, and the broadcast
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (stored.join(F.broadcast(before), "part")
            .select("doc_id", (F.col("before") + F.col("part_start")).alias("start"),
                    "n_tokens", "ids"))


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Stored documents of a few ids; the predicate reaches the stripes' row
    indexes and Bloom filters."""
    return spark.read.schema(STORED).orc(path).where(F.col("doc_id").isin(doc_ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the ids read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            size = pa.array((at[1:] - at[:-1]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), size, pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (tokens.select("doc_id", "start", "n_tokens", "ids")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
