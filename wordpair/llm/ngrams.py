"""Hashed byte n-grams of whole texts, and their counts by class.

Texts are UTF-8 with A-Z in lower case and every run of ASCII white space as
one space, with a space at either end, so that n-grams see word edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordpair.operators.fanin import FAN_IN, merge_tree

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of one text that are hashed at once.
SLICE = 1 << 20


def plain(text: bytes | None) -> bytes:
    return b" " + b" ".join((text or b"").lower().split()) + b" "


def hashed(data: bytes, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket (below 2**bits) of each n-gram of each order (1 to 8 bytes)."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    shift = np.uint64(64 - bits)
    out = []
    gram = np.zeros(len(a), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(a) < n:
            break
        gram = gram[:len(a) - n + 1] | (a[n - 1:] << np.uint64(8 * (n - 1)))
        if n in orders:
            out.append((((gram + np.uint64(n)) * _MIX) >> shift).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def slices(data: bytes, longest: int) -> Iterator[bytes]:
    """Pieces that overlap so that each n-gram lies in at least one (and those
    of the longest order in exactly one)."""
    step = SLICE
    for at in range(0, max(1, len(data) - longest + 1), step):
        yield data[at:at + step + longest - 1]


def few_at_once(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple]:
    """The rows of a batch as Python values (texts as bytes), some at a time: a batch has
    thousands of texts, which need not all be copied at once."""
    for at in range(0, batch.num_rows, rows):
        columns = (c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.slice(at, rows).columns)
        yield from zip(*(c.to_pylist() for c in columns), strict=True)


class Presence:
    """The distinct buckets of a text, without sorting its n-grams."""

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits = orders, bits
        self.mark = np.zeros(1 << bits, bool)

    def __call__(self, text: bytes | None) -> np.ndarray:
        for piece in slices(plain(text), max(self.orders)):
            self.mark[hashed(piece, self.orders, self.bits)] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found.astype(np.int32)


def bucket_counts(text: bytes | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Occurrences per bucket (dense)."""
    total = np.zeros(1 << bits, np.int64)
    for piece in slices(plain(text), max(orders)):
        total += np.bincount(hashed(piece, orders, bits), minlength=1 << bits)
    return total


def add_up(partial: DataFrame, fan: int = FAN_IN) -> DataFrame:
    """``(label, n, counts, part)`` rows of equal-length int64 arrays (as bytes), one a
    label and ``part`` -> one row a label, at most ``fan`` arrays in a group.
    ``partial`` must be stored."""

    def add(table: pa.Table) -> pa.Table:
        total, n = None, 0
        for x, blob in zip(table.column("n").to_pylist(), table.column("counts"), strict=True):
            row = np.frombuffer(blob.as_buffer(), np.int64)
            total = row.copy() if total is None else total + row
            n += x
        return pa.table({"label": pa.array(table.column("label")[:1].to_pylist(), pa.string()),
                         "n": pa.array([n], pa.int64()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    return merge_tree(partial.select("label", "n", "counts", "part"), ["label"], add,
                      "label string, n long, counts binary", fan)
