"""Token -> id encoding and positions on the compacted (in-vocabulary) stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.operators.ordering import dense_index
from wordpair.session import materialize
from wordpair.sources.corpus import Tokens, token_slices

# A vocabulary of up to this many bytes (measured, not estimated from its row
# count: tokens have no length limit) is broadcast to the token scan.  Larger
# ones are joined by shuffle, where AQE splits the partitions of very frequent
# words.
BROADCAST_VOCAB_BYTES = 128 << 20
ROW_OVERHEAD = 40


def vocab_bytes(vocab: DataFrame) -> int:
    row = vocab.agg(F.sum(F.octet_length("word") + F.lit(ROW_OVERHEAD))).first()
    return int(row[0] or 0)


def vocab_is_broadcastable(vocab: DataFrame) -> bool:
    return vocab_bytes(vocab) <= BROADCAST_VOCAB_BYTES


def encode(tokens: Tokens, vocab: DataFrame,
           broadcast: bool | None = None) -> tuple[DataFrame, bool]:
    """Inner join of tokens with the vocabulary: OOV tokens drop out.

    Returns ``(seq_id, *order, id)`` and whether the join was a broadcast.
    """
    if broadcast is None:
        broadcast = vocab_is_broadcastable(vocab)
    v = vocab.select(F.col("word").alias("token"), F.col("id").cast("int").alias("id"))
    if broadcast:
        v = F.broadcast(v)
    enc = tokens.df.join(v, "token").select("seq_id", *tokens.order, "id")
    return enc, broadcast


#: The vocabulary that a worker process looked words up in last, by name.
_TABLE: dict[str, tuple[pa.Array, np.ndarray]] = {}


def _vocab_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: ``(word, id)`` -> compressed Arrow streams."""
    for b in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["words"])


def ids_kernel(vocab: DataFrame) -> Callable | None:
    """mapInArrow function: ``(seq_id, text)`` rows -> ``(seq_id, id)`` rows as ``encode``
    gives them, in order, with the vocabulary (of words that ``vocab_is_broadcastable``
    found small enough) broadcast to the tasks.  None where a word has several ids or a
    null one, which is left to the join."""
    v = vocab.where(F.col("word").isNotNull()).select("word", F.col("id").cast("int").alias("id"))
    most = v.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("k")) \
        .agg(F.max("n"), F.min("k")).first()
    if most[0] is not None and (most[0] > 1 or most[1] < 1):
        return None
    name = uuid.uuid4().hex
    shared = vocab.sparkSession.sparkContext.broadcast(
        [bytes(r[0]) for r in v.mapInArrow(_vocab_rows, "words binary").collect()])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TABLE:
            _TABLE.clear()
            tables = [pa.ipc.open_stream(r).read_all() for r in shared.value]
            if tables:
                t = pa.concat_tables(tables).combine_chunks()
                _TABLE[name] = t.column("word").combine_chunks(), t.column("id").to_numpy()
            else:
                _TABLE[name] = pa.array([], pa.string()), np.zeros(0, np.int32)
        words, ids = _TABLE[name]
        for seq_id, tokens, row in token_slices(batches):
            place = pc.index_in(tokens, value_set=words).fill_null(-1).to_numpy()
            known = place >= 0
            yield pa.RecordBatch.from_arrays([seq_id.take(pa.array(row[known])), pa.array(ids[place[known]])],
                                             names=["seq_id", "id"])
    return f


def compact_positions(tokens: Tokens, vocab: DataFrame, boundary: str = "sequence",
                      broadcast: bool | None = None) -> DataFrame:
    """``(seq_id, gp BIGINT, id INT)``: gp increases by one between consecutive
    in-vocabulary tokens of a sequence (and, for ``boundary='stream'``, across
    sequences in (seq_id, order) order).

    Fast path: when every sequence is one input row and the vocabulary is
    broadcast, the tokens of a sequence never leave the task that split them,
    so ``monotonically_increasing_id`` after the join already numbers them
    consecutively -- no shuffle at all.  Otherwise a range-partitioned sort
    with per-partition offsets (``dense_index``) gives global positions; a hot
    sequence is split across partitions by the range bounds.
    """
    if boundary not in ("sequence", "stream"):
        raise ValueError("boundary must be 'sequence' or 'stream'")
    enc, was_broadcast = encode(tokens, vocab, broadcast)
    if tokens.rowwise and was_broadcast and boundary == "sequence":
        to_ids = ids_kernel(vocab) if tokens.texts is not None else None
        if to_ids:
            enc = tokens.texts.mapInArrow(to_ids, "seq_id long, id int")
        return enc.select("seq_id", F.monotonically_increasing_id().alias("gp"), "id")
    idx = dense_index(enc, ["seq_id", *tokens.order], name="gp")
    return idx.select("seq_id", "gp", "id")


def _number_tokens(batches):
    """(seq_id, id) rows, those of a sequence consecutive -> (seq_id, pos, id)."""
    last, at = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        seq = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.concatenate([[last is None or seq[0] != last], seq[1:] != seq[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(seq)), -1))
        pos = np.arange(len(seq)) - start + 1
        pos[start < 0] = at + 1 + np.arange(int((start < 0).sum()))
        last, at = seq[-1], int(pos[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(pos.astype(np.int32)), b.column(1)], names=["seq_id", "pos", "id"])


RUNS = "part int, seq_id long, pos long, id int, head boolean, last boolean"


def _number_runs(batches):
    """Sorted (seq_id, id) rows of a partition, numbered from 1 in each sequence.
    ``head`` marks the rows of the partition's first sequence, ``last`` its last row."""
    part = TaskContext.get().partitionId()
    first, held = None, None   # the batch before, whose last row may be the partition's

    def out(b, end):
        seq = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.zeros(len(seq), bool)
        last[-1] = end
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(seq), part, np.int32)), b.column(0), b.column(1).cast(pa.int64()), b.column(2),
             pa.array(seq == first), pa.array(last)], names=["part", "seq_id", "pos", "id", "head", "last"])

    for b in _number_tokens(batches):
        first = b.column(0)[0].as_py() if held is None else first
        if held is not None:
            yield out(held, False)
        held = b
    if held is not None:
        yield out(held, True)


def _carried(runs: DataFrame) -> DataFrame:
    """``(part, carry)``: how many rows of a partition's first sequence lie in the
    partitions before it (one row a partition, on the driver)."""
    ends = runs.where("last").select("part", "seq_id", "pos", "head")
    heads = runs.where("head").groupBy("part").agg(F.min("seq_id").alias("first"))
    carry, before, rows = 0, None, []
    for r in sorted(ends.join(heads, "part").collect(), key=lambda r: r["part"]):
        carry = carry if before is not None and before == r["first"] else 0
        rows.append((r["part"], carry))
        # rows so far of the sequence that the next partition may go on with
        carry, before = r["pos"] + (carry if r["head"] else 0), r["seq_id"]
    return runs.sparkSession.createDataFrame(rows, "part int, carry long")


def tokenize(tokens: Tokens, vocab: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """``(seq_id, pos INT, id INT)`` with pos = 1..n_kept per sequence.

    Where each sequence is one input row and the vocabulary is broadcast, the
    tokens are numbered in the scan task and nothing is shuffled.  Else tokens are
    range sorted once and numbered in their partition; only a sequence that began in
    an earlier partition adds what lies there, so no token meets its start by a join."""
    if broadcast is None:
        broadcast = vocab_is_broadcastable(vocab)
    to_ids = ids_kernel(vocab) if tokens.texts is not None and broadcast else None
    if to_ids:
        return tokens.texts.mapInArrow(lambda batches: _number_tokens(to_ids(batches)), "seq_id long, pos int, id int")
    enc, was_broadcast = encode(tokens, vocab, broadcast)
    if tokens.rowwise and was_broadcast:
        return enc.select("seq_id", "id").mapInArrow(_number_tokens, "seq_id long, pos int, id int")
    order = ["seq_id", *tokens.order]
    runs = (enc.repartitionByRange(*order).sortWithinPartitions(*order).select("seq_id", "id")
            .mapInArrow(_number_runs, RUNS))
    runs = materialize(runs, "runs")
    return (runs.join(F.broadcast(_carried(runs)), "part", "left")
            .select("seq_id", (F.col("pos") + F.when(F.col("head"), F.coalesce("carry", F.lit(0))).otherwise(0))
                    .cast("int").alias("pos"), "id"))


def decode(ids: DataFrame, vocab: DataFrame, id_col: str = "id", word_col: str = "word") -> DataFrame:
    """Attach words to ids (left join, unknown ids keep a NULL word)."""
    v = vocab.select(F.col("id").alias(id_col), F.col("word").alias(word_col))
    return ids.join(v, id_col, "left")


def word_ids(words: DataFrame, vocab: DataFrame, word_col: str = "word",
             lowercase: bool = False, out_col: str = "id") -> DataFrame:
    """Id of each word, 0 when absent."""
    key = F.lower(F.col(word_col)) if lowercase else F.col(word_col)
    w = words.withColumn("_key", key)
    v = vocab.select(F.col("word").alias("_key"), F.col("id").alias("_vid"))
    return (w.join(v, "_key", "left")
             .withColumn(out_col, F.coalesce(F.col("_vid"), F.lit(0)).cast("int"))
             .drop("_key", "_vid"))
