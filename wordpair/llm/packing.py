"""Best-fit packing of documents into sequences of a fixed number of tokens.

Texts are encoded in the scan task and only lengths go on: pieces of full
length are sequences of their own; the others are dealt evenly into packing
groups of a bounded number of pieces, and each group is packed by best-fit
decreasing in one task.  The open sequences are kept by remaining capacity in a
segment tree, so the tightest one that holds a piece is found in
O(log capacity).  Groups are sized by tokens: one that fills a thousand sequences
packs about as well as all pieces together.  A group leaves at most one sequence that
is half empty or worse; what lies in those is packed again, until one group is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.llm.memory import trimmed
from wordpair.llm.store import columns_of, new_name, written
from wordpair.llm.word_bpe import encoder

CAPACITY = 4096
#: Pieces a packing group at least and at most (bounds the rows of a task), and the
#: sequences its tokens fill: of short pieces a group takes more.
GROUP_PIECES, MOST_PIECES = 8192, 1 << 19
GROUP_SEQUENCES = 1000
#: Rounds of packing at most: each has at most half as many groups as the one before.
LEVELS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        node = left + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a bin of the smallest remaining capacity >= need."""
        node = need + self.size
        if not self.count[node]:
            # up to the first right sibling that holds a bin, then down its left edge
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.size
        bin_ = self.bins[left].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return left, bin_


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all in 0..capacity)."""
    tree = OpenBins(capacity)
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    opened = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if not n:
            break   # the last ones: offset 0 of the first bin
        got = tree.tightest(n)
        if got is None:
            left, bin_ = capacity, opened
            opened += 1
        else:
            left, bin_ = got
        bins[i], offsets[i] = bin_, capacity - left
        if left > n:
            tree.put(left - n, bin_)
    return bins, offsets


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
              text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1,
              with_ids: bool = False) -> DataFrame:
    """Encoded documents cut into pieces of at most ``capacity`` ids:
    ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A null or empty text is the end id alone.  Only documents longer than the
    capacity are cut.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        # few documents at a time: a text's ids take several times its bytes
        for some in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            ids = some.column(0).to_pylist()
            rows: list[tuple] = []
            bodies: list[np.ndarray] = []
            for doc_id, body in zip(ids, enc.encode_many(some.column(1).to_pylist()), strict=True):
                body = np.concatenate([body, end]).astype("<u4")
                for k, at in enumerate(range(0, len(body), capacity)):
                    part = body[at:at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        bodies.append(part)
            cols = [pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True) if rows else [[]] * 5,
                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0, *map(len, bodies)])
                flat = np.concatenate(bodies).astype(np.int32) if bodies else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), schema)


def pieces_a_group(n: int, tokens: int, capacity: int) -> int:
    """So many of ``n`` pieces as fill GROUP_SEQUENCES sequences, within the bounds."""
    return min(MOST_PIECES, max(GROUP_PIECES, -(-GROUP_SEQUENCES * capacity * n // max(1, tokens))))


def assign(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of at most
    ``capacity``; other columns (an ``ids`` array, say) go along unchanged.

    Rows are dealt by their place in the stored table, so repeated ids, ties and
    null ids spread evenly.  Each group may leave one sequence half empty or worse;
    what lies in those is packed again, level by level, until one group is left.
    Rows of length 0 get offset 0 of the first sequence of their group.
    """
    place, bin_, poor, group_ = (new_name(c, [*pieces.columns, "offset", "sequence_id"])
                                 for c in ("__place", "__bin", "__poor", "__group"))
    names = pieces.columns
    pieces = written(pieces, "pieces").withColumn(place, F.monotonically_increasing_id())
    full = pieces.where(F.col("length") >= capacity)
    done = full.select(*columns_of(full.drop(place)), (F.col(place) * 2 + 1).alias("sequence_id"),
                       F.lit(0).cast("long").alias("offset"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    def packer(groups: int):
        def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by(place)
            length = table.column("length").to_numpy()
            bins, offsets = best_fit_decreasing(length, capacity)
            half_empty = 2 * np.bincount(bins, weights=length) <= capacity
            return (table.select([*names, place])
                    .append_column(bin_, pa.array(bins * groups + key[0].as_py(), pa.int64()))
                    .append_column("offset", pa.array(offsets, pa.int64()))
                    .append_column(poor, pa.array(half_empty[bins] & (length > 0))))
        return pack

    part, level, most = pieces.where(F.col("length") < capacity), 0, math.inf
    while True:
        n, tokens = part.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(most, -(-n // (group_pieces or pieces_a_group(n, tokens, capacity)))))
        # a partition's rows go round all groups, and partitions start at different ones
        turn = F.shiftright(place, 33) * 7919 + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))

        packed = (part.withColumn(group_, F.pmod(turn, F.lit(groups))).groupBy(group_)
                  .applyInArrow(packer(groups), kinds + f", `{bin_}` bigint, offset bigint, `{poor}` boolean"))
        # one job packs and tells what is packed again
        packed = written(packed, "packed") if groups > 1 else packed
        good = packed if groups == 1 else packed.where(~F.col(poor))
        # even numbers: shared sequences of each level, odd ones: full pieces
        done = done.unionByName(good.select(
            *columns_of(pieces.drop(place)), ((F.col(bin_) * LEVELS + level) * 2).alias("sequence_id"), "offset"))
        if groups == 1:
            return done
        part, level, most = packed.where(F.col(poor)).drop(bin_, "offset", poor), level + 1, groups // 2


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``assign`` over pieces with ids:
    ``sequence_id, ids, doc_ids, starts`` (a sequence has at most ``capacity``
    ids, so its group is bounded)."""
    items = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    g = packed.where("length > 0").groupBy("sequence_id").agg(items.alias("items"))
    return g.select("sequence_id", F.flatten(F.col("items.ids")).alias("ids"),
                    F.col("items.doc_id").alias("doc_ids"), F.col("items.offset").alias("starts"))


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row
    a piece.  Documents that repeat an id are packed each; an empty table gives
    an empty result."""
    return assign(pieces_of(docs, tokenizer_path, **options))
