"""Adding up pair counts: compact partial sums, one shuffle, a merge in order.

Counts of (w1, w2) are added up in a task first, in chunks of bounded size: sorted
unique keys and their counts.  A chunk goes out as one row a bucket of words w2 (the
rarer word of a pair, so no bucket is hot), which holds the differences of its sorted
keys and the counts by byte planes, compressed: some 3 bytes a pair where a row of
three numbers takes 16 or more.  Rows are shuffled and sorted by bucket, and a task
adds up a few buckets at a time, so it holds no more than ``MERGE_KEYS`` partial sums
or one bucket's.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PAIR_SCHEMA = "w1 int, w2 int, x long"
PACKED_SCHEMA = "bucket int, packed binary"
PACKED_COLUMNS = ["bucket", "packed"]
#: Pairs a task holds before it adds them up, and partial sums that it merges at once.
CHUNK_KEYS, MERGE_KEYS = 1 << 23, 1 << 22
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 1 << 18
#: 2**BUCKET_BITS buckets of words.  A key is bucket | w2 without its lowest bits | w1.
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
_SHIFT = np.uint64(64 - BUCKET_BITS)
_BITS, _32 = np.uint64(BUCKET_BITS), np.uint64(32)
_INT = np.uint64(0xFFFFFFFF)
_REST = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
_HEAD, _HEAD_SIZE = "<qbb", 10

_PACKED = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_PAIRS = pa.schema([("w1", pa.int32()), ("w2", pa.int32()), ("x", pa.int64())])


def high_bits(w2: np.ndarray) -> np.ndarray:
    """The part of a key that w2 gives; ``| w1`` makes it whole."""
    u = w2.astype(np.int32).view(np.uint32).astype(np.uint64)
    return (u << _SHIFT) | ((u >> _BITS) << _32)


def _words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w2 = (((keys & _REST) >> _32) << _BITS) | (keys >> _SHIFT)
    return (keys & _INT).astype(np.uint32).view(np.int32), w2.astype(np.uint32).view(np.int32)


def _first(keys: np.ndarray) -> np.ndarray:
    """Where each value of sorted keys begins."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def reduced(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unique keys and how often each occurs; ``keys`` is sorted in place."""
    keys.sort()
    at = _first(keys)
    return keys[at], np.diff(at, append=len(keys))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unique keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = _first(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _bits(values: np.ndarray) -> int:
    return max(1, int(values.max()).bit_length())


def _summed_bucket(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``summed`` for keys without their bucket: key and count become one number where
    they fit, so that plain numbers are sorted."""
    w1, rest = keys & _INT, keys >> _32
    n1, n_rest, n = _bits(w1), _bits(rest), _bits(counts)
    if counts.min() < 0 or n1 + n_rest + n > 64:
        return summed(keys, counts)
    n1, n = np.uint64(n1), np.uint64(n)
    rest <<= n1
    rest |= w1
    rest <<= n
    rest |= counts.view(np.uint64)
    rest.sort()
    key = rest >> n
    at = _first(key)
    rest &= (np.uint64(1) << n) - np.uint64(1)
    key = key[at]
    return ((key >> n1) << _32) | (key & ((np.uint64(1) << n1) - np.uint64(1))), np.add.reduceat(rest, at).view(np.int64)


def _planes(values: np.ndarray, starts: np.ndarray) -> tuple[list[memoryview], list[int]]:
    """The values' bytes, all lowest ones first, and how many the largest one of each
    stretch needs."""
    widths = [max(1, (v.bit_length() + 7) // 8) for v in np.maximum.reduceat(values, starts).tolist()]
    bytes_ = values.view(np.uint8).reshape(-1, 8)
    return [memoryview(np.ascontiguousarray(bytes_[:, j])) for j in range(max(widths))], widths


def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket of sorted unique keys."""
    if not len(keys):
        return pa.RecordBatch.from_pylist([], schema=_PACKED)
    ends = np.append(np.searchsorted(keys, np.arange(BUCKETS, dtype=np.uint64) << _SHIFT), len(keys))
    names = np.flatnonzero(np.diff(ends))
    starts = ends[names]
    step = np.diff(keys, prepend=np.uint64(0))
    step[starts] = keys[starts] & _REST
    key_planes, key_widths = _planes(step, starts)
    count_planes, count_widths = _planes(counts.astype(np.int64).view(np.uint64), starts)
    rows = []
    for a, z, kw, cw in zip(starts.tolist(), ends[names + 1].tolist(), key_widths, count_widths):
        planes = b"".join([p[a:z] for p in key_planes[:kw]] + [p[a:z] for p in count_planes[:cw]])
        rows.append(struct.pack(_HEAD, z - a, kw, cw) + pa.compress(planes, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(rows, pa.binary())], schema=_PACKED)


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys without their bucket and counts of rows behind one another."""
    heads = [struct.unpack_from(_HEAD, row) for row in rows]
    held = sum(n for n, _, _ in heads)
    keys, counts, at = np.zeros(held, np.uint64), np.zeros(held, np.int64), 0
    key_bytes, count_bytes = (v.view(np.uint8).reshape(-1, 8) for v in (keys, counts))
    for row, (n, kw, cw) in zip(rows, heads):
        planes = np.frombuffer(pa.decompress(memoryview(row)[_HEAD_SIZE:], n * (kw + cw), "zstd"), np.uint8)
        planes = planes.reshape(kw + cw, n)
        for j in range(kw):
            key_bytes[at:at + n, j] = planes[j]
        for j in range(cw):
            count_bytes[at:at + n, j] = planes[kw + j]
        key = keys[at:at + n]
        key.cumsum(out=key)
        at += n
    return keys, counts


def _odd_sums(rows: list) -> pa.Table:
    """Sums of rows with nulls, as SQL has them."""
    t = pa.Table.from_batches(rows, _PAIRS).group_by(["w1", "w2"]).aggregate([("x", "sum")])
    return t.rename_columns([{"x_sum": "x"}.get(c, c) for c in t.column_names]).select(_PAIRS.names)


def _odd_packed(rows: list) -> pa.RecordBatch:
    """Rows with nulls, one a key, as they are; their head says that they hold 0 keys."""
    t = _odd_sums(rows).to_pylist()
    bare = [pa.RecordBatch.from_pylist([r], schema=_PAIRS).serialize().to_pybytes() for r in t]
    return pa.RecordBatch.from_arrays(
        [pa.array([((r["w1"] or 0) if r["w2"] is None else r["w2"]) % BUCKETS for r in t], pa.int32()),
         pa.array([struct.pack(_HEAD, 0, 0, 0) + b for b in bare], pa.binary())], schema=_PACKED)


def pack_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: rows ``(w1, w2, x)`` -> ``PACKED`` partial sums."""
    keys, counts, odd, held, odd_held = [], [], [], 0, 0
    for b in batches:
        if any(c.null_count for c in b.columns):
            whole = b.column(0).is_valid()
            for c in b.columns[1:]:
                whole = pc.and_(whole, c.is_valid())
            rest = b.filter(pc.invert(whole)).cast(_PAIRS)
            odd.append(rest)
            odd_held += rest.num_rows
            b = b.filter(whole)
        w1, w2, x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        keys.append(high_bits(w2) | w1.astype(np.int32).view(np.uint32).astype(np.uint64))
        counts.append(x.astype(np.int64))
        held += len(w1)
        if held >= MERGE_KEYS:
            yield packed(*summed(np.concatenate(keys), np.concatenate(counts)))
            keys, counts, held = [], [], 0
        if odd_held >= OUT_ROWS:
            yield _odd_packed(odd)
            odd, odd_held = [], 0
    if held:
        yield packed(*summed(np.concatenate(keys), np.concatenate(counts)))
    if odd_held:
        yield _odd_packed(odd)


def count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: lists of numbers ``w1 * 2**32 + w2``, one a pair found (ids from 0 on) or
    null -> ``PACKED`` counts."""
    buf, used = np.empty(CHUNK_KEYS, np.uint64), 0
    for b in batches:
        pair = b.column(0).flatten().drop_null().to_numpy(zero_copy_only=False)
        for at in range(0, len(pair), CHUNK_KEYS):
            part = pair[at:at + CHUNK_KEYS]
            if used + len(part) > CHUNK_KEYS:
                yield packed(*reduced(buf[:used]))
                used = 0
            buf[used:used + len(part)] = high_bits(part & 0xFFFFFFFF) | (part >> 32).astype(np.uint64)
            used += len(part)
    if used:
        yield packed(*reduced(buf[:used]))


def _sums(sums: list, odd: list) -> Iterator[pa.RecordBatch]:
    if sums:
        k, x = (np.concatenate(c) for c in zip(*sums))
        t = pa.Table.from_arrays([*map(pa.array, _words(k)), pa.array(x)], schema=_PAIRS)
        if odd:   # a null count beside others of its pair
            t = _odd_sums(odd + t.to_batches())
        yield from t.to_batches(max_chunksize=OUT_ROWS)
    elif odd:
        yield from _odd_sums(odd).to_batches()


def add_up_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: ``PACKED`` rows in order of bucket -> ``(w1, w2, x)``, one row a pair.
    A bucket is added up on its own; sums of ``OUT_ROWS`` pairs go out together."""
    rows, sums, odd, held, last = [], [], [], 0, None

    def close() -> int:
        """Add up the bucket at hand; the number of its sums."""
        if not rows:
            return 0
        k, x = _summed_bucket(*_unpacked(rows))
        k |= np.uint64(last << (64 - BUCKET_BITS))
        sums.append((k, x))
        rows.clear()
        return len(k)

    for b in batches:
        for bucket, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != last:
                held += close()
                if held >= OUT_ROWS:
                    yield from _sums(sums, odd)
                    sums, odd, held = [], [], 0
                last = bucket
            if struct.unpack_from(_HEAD, row)[0]:
                rows.append(row)
            else:
                odd.append(pa.ipc.read_record_batch(pa.py_buffer(row[_HEAD_SIZE:]), _PAIRS))
                held += 1
    close()
    yield from _sums(sums, odd)


def add_up(partial: DataFrame) -> DataFrame:
    """``PACKED`` partial sums of any tasks -> ``(w1 INT, w2 INT, x BIGINT)``."""
    return (partial.select("bucket", "packed").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(add_up_kernel, PAIR_SCHEMA))


def pack(pairs: DataFrame) -> DataFrame:
    """Rows ``(w1, w2, x)``, pairs repeated or not -> ``PACKED`` partial sums."""
    return pairs.selectExpr("cast(w1 as int) w1", "cast(w2 as int) w2", "cast(x as bigint) x") \
        .mapInArrow(pack_kernel, PACKED_SCHEMA)
