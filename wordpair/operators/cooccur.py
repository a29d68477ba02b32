"""Sliding-window co-occurrence counts (the positional band self-join).

For every in-vocabulary token at compacted position i, every token at
i+1 .. i+window is a partner; equal ids are skipped (they still use up a
slot) and the pair is stored once as (min, max) with a BIGINT count.

Plan: positions are cut into blocks of ``block_size`` (a power of two).  A
block carries its own tokens plus a right halo -- the first ``window``
tokens of the next block -- so each token finds all partners inside one
bounded group.  Per block the ids are collected in position order, each
owned element is paired with the next ``window`` elements by their places
in the block, and the pairs are added up in the task
(``operators/pair_sums.py``) before the only large shuffle.  Group size is
``block_size + window`` whatever the length of a document, so a single
huge sequence is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordpair.operators.encode import compact_positions, encode, ids_kernel
from wordpair.operators.pair_sums import PACKED_COLUMNS, PACKED_SCHEMA, add_up, count_kernel, pack
from wordpair.operators.pairs_arrow import (PAIR_ARROW_SCHEMA, SORTED_OUT_SCHEMA,
                                            block_pairs_kernel, boundary_pairs_kernel,
                                            sorted_partition_kernel, window_pairs_kernel)
from wordpair.session import materialize
from wordpair.sources.corpus import Tokens

PAIR_SCHEMA = "w1 INT, w2 INT, x BIGINT"
#: Pairs that go to a task's sums in one row (a row costs far more than a number in it; the
#: code made for some 10 is too long for the JVM to compile).
PAIRS_A_ROW = 5


def window_pairs(pos: DataFrame, window: int = 10, boundary: str = "sequence",
                 block_size: int = 1024, engine: str = "arrow") -> DataFrame:
    """``(w1 INT, w2 INT, x BIGINT)``, w1 < w2, from ``(seq_id, gp, id)``.

    ``engine='sql'``: collect + explode of places per block (all built-ins);
    ``engine='arrow'``: the same block groups counted by a vectorised numpy
    pass per group (``applyInArrow``), pre-aggregated before the shuffle.
    """
    return add_up(_block_counts(pos, window, boundary, block_size, engine))


def _block_counts(pos: DataFrame, window: int, boundary: str, block_size: int, engine: str) -> DataFrame:
    if window < 1:
        raise ValueError("window must be >= 1")
    if block_size < window or block_size & (block_size - 1):
        raise ValueError("block_size must be a power of two >= window")
    shift = block_size.bit_length() - 1
    mask = block_size - 1
    gp = F.col("gp")
    blk = F.shiftright(gp, shift)
    keys = (F.when(gp.bitwiseAND(F.lit(mask)) < window, F.array(blk, blk - 1))
             .otherwise(F.array(blk)))
    if engine == "arrow":
        rows = pos.select(F.explode(keys).alias("blk"), gp.alias("gp"), "seq_id", "id")
        parts = rows.groupBy("blk").applyInArrow(
            block_pairs_kernel(window, shift, boundary == "sequence"), PAIR_ARROW_SCHEMA)
        return pack(parts)
    t = pos.select(F.explode(keys).alias("blk"),
                   F.struct(gp.alias("gp"), F.col("seq_id").alias("seq_id"),
                            F.col("id").alias("id")).alias("t"))
    # arrays of plain numbers: a pair is two places in a block, no struct is made for it
    g = t.groupBy("blk").agg(F.sort_array(F.collect_list("t")).alias("ts")) \
        .select("blk", F.col("ts.gp").alias("gps"), F.col("ts.seq_id").alias("seqs"), F.col("ts.id").alias("ids"))
    owned = (g.select("blk", "gps", "seqs", "ids", F.posexplode("gps").alias("i", "gp"))
              .where(F.shiftright(F.col("gp"), shift) == F.col("blk")))
    p = owned.select("gps", "seqs", "ids", "gp", F.get("seqs", F.col("i")).alias("seq_id"),
                     F.get("ids", F.col("i")).alias("wi"), "i",
                     F.explode(F.array(*[F.lit(k) for k in range(1, window + 1, PAIRS_A_ROW)])).alias("k"))
    p = p.select("*", (F.col("i") + F.col("k")).alias("j"))

    def pair(j) -> F.Column:
        """A pair is one number on its way to the task's sums; null where there is none."""
        u = F.get("ids", j)
        # places past the window have a larger distance, those past the block are null
        cond = ((F.get("gps", j) - F.col("gp")) <= window) & (u != F.col("wi"))
        if boundary == "sequence":
            cond = cond & (F.get("seqs", j) == F.col("seq_id"))
        return F.when(cond, F.shiftleft(F.least(F.col("wi"), u).cast("bigint"), 32)
                      + F.greatest(F.col("wi"), u).cast("bigint"))
    return p.select(F.array(*[pair(F.col("j") + k) for k in range(PAIRS_A_ROW)]).alias("pairs")) \
        .mapInArrow(count_kernel, PACKED_SCHEMA)


def cooccurrence(tokens: Tokens, vocab: DataFrame, window: int = 10, boundary: str = "sequence",
                 block_size: int = 1024, broadcast: bool | None = None, method: str = "auto",
                 engine: str = "arrow", packed: bool = False) -> DataFrame:
    """Encode, then count window pairs.

    ``method``: 'scan' counts in the scan tasks with no token shuffle (one row
    per sequence and a broadcast vocabulary, else an error); 'sorted' sorts the
    encoded stream once and counts in one pass (``sorted_stream_pairs``);
    'blocks' makes bounded block/halo groups of global positions; 'auto' is
    'scan' where it applies and 'sorted' elsewhere.

    ``packed`` gives the counts as tasks leave them before their shuffle, partial sums
    ``PACKED_SCHEMA`` (``operators/pair_sums.py``), for ``merge_counts`` to add up with
    those of other tables.
    """
    counts = _task_counts(tokens, vocab, window, boundary, block_size, broadcast, method, engine)
    return counts if packed else add_up(counts)


def _task_counts(tokens: Tokens, vocab: DataFrame, window: int, boundary: str, block_size: int,
                 broadcast: bool | None, method: str, engine: str) -> DataFrame:
    if window < 1:
        raise ValueError("window must be >= 1")
    if method not in ("auto", "scan", "blocks", "sorted"):
        raise ValueError("method must be 'auto', 'scan', 'blocks' or 'sorted'")
    if method == "blocks":
        pos = compact_positions(tokens, vocab, boundary, broadcast)
        return _block_counts(pos, window, boundary, block_size, engine)
    enc, was_broadcast = encode(tokens, vocab, broadcast)
    in_scan = tokens.rowwise and boundary == "sequence" and was_broadcast
    if method == "scan" and not in_scan:
        raise ValueError("'scan' needs one row per sequence, sequence boundaries and a vocabulary "
                         "small enough to broadcast")
    # texts are split and looked up in the task that counts
    to_ids = ids_kernel(vocab) if was_broadcast and tokens.texts is not None else None
    if in_scan and method != "sorted":
        if to_ids:
            count = window_pairs_kernel(window, True)
            return tokens.texts.mapInArrow(lambda batches: count(to_ids(batches)), PACKED_SCHEMA)
        return enc.select("seq_id", "id").mapInArrow(window_pairs_kernel(window, True), PACKED_SCHEMA)
    if to_ids and _distinct(tokens.texts, "seq_id"):
        return _stream_counts(tokens.texts, ["seq_id"], window, boundary, to_ids=to_ids)
    return _stream_counts(enc, ["seq_id", *tokens.order], window, boundary)


def _distinct(df: DataFrame, col: str) -> bool:
    return df.groupBy(col).count().where("count > 1").limit(1).count() == 0


def sorted_stream_pairs(enc: DataFrame, order_cols, window: int = 10,
                        boundary: str = "sequence", num_partitions: int | None = None,
                        to_ids: Callable | None = None) -> DataFrame:
    """Window pairs of an encoded stream ``(seq_id, *order, id)`` of any shape, or of
    ``(seq_id, text)`` rows that ``to_ids`` encodes once they are sorted (a sequence is
    one row then, and texts are what is shuffled).

    One range-partitioned sort on the order columns (a hot sequence is split
    over many partitions) and ONE in-task Arrow pass over it: a sorted partition
    is a contiguous piece of the stream, so the pass counts the pairs inside it
    and reports its first/last ``window`` tokens and its size.  Its output is
    stored, so both kinds of rows come from the same partition boundaries
    whatever is recomputed.  The edge rows -- at most 2 window + 1 per
    partition -- get global positions from per-partition offsets; a pair that
    straddles partitions lies within 2 window edge rows of position, so edges
    are compared in blocks of positions with a halo, not in one task.
    """
    return add_up(_stream_counts(enc, order_cols, window, boundary, num_partitions, to_ids))


def _stream_counts(enc: DataFrame, order_cols, window: int, boundary: str, num_partitions: int | None = None,
                   to_ids: Callable | None = None) -> DataFrame:
    same = boundary == "sequence"
    s = (enc.repartitionByRange(num_partitions, *order_cols) if num_partitions
         else enc.repartitionByRange(*order_cols)).sortWithinPartitions(*order_cols)
    kernel = sorted_partition_kernel(window, same)
    rows = s.mapInArrow(lambda batches: kernel(to_ids(batches)), SORTED_OUT_SCHEMA) if to_ids \
        else s.select("seq_id", "id").mapInArrow(kernel, SORTED_OUT_SCHEMA)
    out = materialize(rows, "stream-pairs")
    inner = out.where(F.col("kind") == 0).select("bucket", "packed")
    counts = out.where(F.col("kind") == 2).select("pid", F.col("idx").alias("n"))
    # one row a partition: bounded by the partition count
    offs = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("off"))
    edge = (out.where(F.col("kind") == 1).join(F.broadcast(offs), "pid")
               .select("pid", (F.col("off") + F.col("idx")).alias("gpos"), "seq_id", "w1"))
    # block = position / (64 windows); a token also goes to the block before it when a
    # left partner may lie there
    size = 64 * window
    block = F.floor(F.col("gpos") / size)
    edge = edge.select("*", block.alias("own"), F.explode(F.array_distinct(
        F.array(block, F.floor((F.col("gpos") - window) / size)))).alias("block"))
    cross = edge.groupBy("block").applyInArrow(boundary_pairs_kernel(window, same), PAIR_ARROW_SCHEMA)
    return inner.unionByName(pack(cross))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both orientations (w, c, x) of every stored pair; zero diagonal.

    A view over the canonical upper-triangle table; one pass (explode of a
    two-element array), no union of two scans.
    """
    both = F.array(F.struct(F.col("w1").alias("w"), F.col("w2").alias("c")),
                   F.struct(F.col("w2").alias("w"), F.col("w1").alias("c")))
    return pairs.select(F.explode(both).alias("e"), "x").select("e.w", "e.c", "x")


def upper_triangle(entries: DataFrame, row: str = "w", col: str = "c", val: str = "x",
                   n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """P5: strict upper triangle (row < col) of a COO table.

    ``n_rows`` and ``n_cols`` give the matrix's shape where it is known; a matrix
    that is not square is an error."""
    if n_rows != n_cols:
        raise ValueError(f"the matrix must be square, not {n_rows} x {n_cols}")
    return (entries.where(F.col(row) < F.col(col))
                   .select(F.col(row).alias("w1"), F.col(col).alias("w2"), F.col(val).alias("x")))


def merge_counts(*pair_tables: DataFrame) -> DataFrame:
    """Merge pair-count tables with +, e.g. an old table and new documents.

    A table is ``(w1, w2, x)`` rows or what ``cooccurrence(packed=True)`` gives.  Its
    partial sums are shuffled and added up once, together with those of all tables,
    rather than a table at a time and then again as rows."""
    parts = [t if t.columns == PACKED_COLUMNS else pack(t) for t in pair_tables]
    return add_up(reduce(DataFrame.unionByName, parts))


def matrix_facts(pairs: DataFrame) -> DataFrame:
    """A5: non-zeros of the symmetric matrix, total count, max id, symmetry.

    The stored form is canonical (w1 < w2), so the symmetric view is symmetric
    with a zero diagonal by construction; ``symmetric`` checks it anyway.
    """
    return pairs.agg(
        (2 * F.count(F.lit(1))).cast("bigint").alias("nnz"),
        (2 * F.coalesce(F.sum("x"), F.lit(0))).cast("bigint").alias("total"),
        F.coalesce(F.greatest(F.max("w1"), F.max("w2")), F.lit(0)).cast("int").alias("n"),
        F.coalesce(F.min(F.col("w1") < F.col("w2")), F.lit(True)).alias("symmetric"),
    )


def pair_marginals(pairs: DataFrame) -> DataFrame:
    """Row sums of the symmetric matrix, ``(id INT, row_sum BIGINT)``."""
    return (pairs.select(F.explode(F.array("w1", "w2")).alias("id"), "x")
                 .groupBy("id").agg(F.sum("x").cast("bigint").alias("row_sum")))
