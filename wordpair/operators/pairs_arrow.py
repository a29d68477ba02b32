"""Window pairs over an ordered token stream inside each task (Arrow + numpy).

Used when every sequence lies in one input row and the vocabulary is
broadcast: after the narrow split + broadcast join, the in-vocabulary
tokens of a sequence arrive consecutively and in order in one task, so the
positional look-ahead needs no shuffle at all.  Each task keeps the last
``window`` tokens of the previous Arrow batch as a carry, forms the
(id_i, id_i+k) pairs for k = 1..window with vectorised comparisons, and
adds them up (sorted unique keys and counts) in bounded chunks
(``operators/pair_sums.py``) before the one large shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wordpair.operators.pair_sums import CHUNK_KEYS, high_bits, packed, reduced

PAIR_ARROW_SCHEMA = "w1 int, w2 int, x long"


def _count(keys: list[np.ndarray]) -> pa.RecordBatch | None:
    if not keys:
        return None
    k = np.concatenate(keys)
    if len(k) == 0:
        return None
    u, c = np.unique(k, return_counts=True)
    return pa.RecordBatch.from_pydict({
        "w1": pa.array((u >> np.uint64(32)).astype(np.int32)),
        "w2": pa.array((u & np.uint64(0xFFFFFFFF)).astype(np.int32)),
        "x": pa.array(c.astype(np.int64))})


def window_pairs_kernel(window: int, same_sequence: bool = True, chunk: int | None = None):
    """mapInArrow function: ``(seq_id, id)`` rows in stream order -> partial counts
    ``PACKED`` (w1 < w2, equal ids skipped), added up every ``chunk`` pairs."""
    chunk = chunk or CHUNK_KEYS

    def f(batches):
        carry_s = np.zeros(0, np.int64)
        carry_i = np.zeros(0, np.int64)
        buf = np.empty(chunk + window, np.uint64)
        used = 0
        # a piece's pairs fit the buffer
        step = max(1, chunk // window)
        for b in batches:
            all_s = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            all_i = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, b.num_rows, step):
                s = np.concatenate([carry_s, all_s[at:at + step]])
                ids = np.concatenate([carry_i, all_i[at:at + step]])
                c = len(carry_s)          # carried rows are only left partners of new rows
                n = len(ids)
                if used + (n - c) * window > len(buf):
                    yield packed(*reduced(buf[:used]))
                    used = 0
                low, high = ids.astype(np.uint64), high_bits(ids)
                for k in range(1, window + 1):
                    lo = max(c - k, 0)    # left index range whose right partner is a new row
                    if lo >= n - k:
                        continue
                    a, z = ids[lo:n - k], ids[lo + k:n]
                    ok = a != z
                    if same_sequence:
                        ok &= s[lo:n - k] == s[lo + k:n]
                    key = np.where(a < z, high[lo + k:n] | low[lo:n - k], high[lo:n - k] | low[lo + k:n])[ok]
                    buf[used:used + len(key)] = key
                    used += len(key)
                carry_s, carry_i = s[-window:], ids[-window:]
        if used:
            yield packed(*reduced(buf[:used]))
    return f


def block_pairs_kernel(window: int, shift: int, same_sequence: bool = True):
    """applyInArrow function for one block group of ``(blk, gp, seq_id, id)``
    rows (owned tokens plus the right halo): pairs whose left token is owned
    by the block and whose distance in gp is at most ``window``."""
    out_schema = pa.schema([("w1", pa.int32()), ("w2", pa.int32()), ("x", pa.int64())])

    def f(t: pa.Table) -> pa.Table:
        if t.num_rows == 0:
            return out_schema.empty_table()
        blk = int(t.column("blk")[0].as_py())
        gp = t.column("gp").to_numpy()
        order = np.argsort(gp, kind="stable")
        gp = gp[order]
        s = t.column("seq_id").to_numpy()[order]
        ids = t.column("id").to_numpy().astype(np.int64)[order]
        owned = (gp >> shift) == blk
        n = len(ids)
        keys = []
        for k in range(1, window + 1):
            if k >= n:
                break
            a, z = ids[:n - k], ids[k:]
            ok = owned[:n - k] & (gp[k:] - gp[:n - k] <= window) & (a != z)
            if same_sequence:
                ok &= s[:n - k] == s[k:]
            a, z = a[ok], z[ok]
            keys.append((np.minimum(a, z).astype(np.uint64) << np.uint64(32))
                        | np.maximum(a, z).astype(np.uint64))
        b = _count(keys)
        return pa.Table.from_batches([b]) if b is not None else out_schema.empty_table()
    return f


SORTED_OUT_SCHEMA = "kind int, pid int, idx long, seq_id long, w1 int, bucket int, packed binary"
_SORTED_OUT = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("idx", pa.int64()),
                         ("seq_id", pa.int64()), ("w1", pa.int32()), ("bucket", pa.int32()),
                         ("packed", pa.binary())])


def _sorted_rows(kind, pid, n, **columns) -> pa.RecordBatch:
    columns |= {"kind": np.full(n, kind), "pid": np.full(n, pid)}
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array)
         else pa.array(np.asarray(columns[f.name]), f.type) for f in _SORTED_OUT], schema=_SORTED_OUT)


def sorted_partition_kernel(window: int, same_sequence: bool, window_pairs: bool = True):
    """mapInArrow over a range-sorted token stream ``(seq_id, id)``.

    Emits kind 0: packed partial pair counts inside the partition (only when
    ``window_pairs``); kind 1: the
    first and last ``window`` tokens with their index in the partition
    (w1 = id); kind 2: the partition's token count (idx).  Kinds 1 and 2
    are at most 2 window + 1 rows per partition.
    """
    inner = window_pairs_kernel(window, same_sequence) if window_pairs else None

    def f(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        head_s, head_i = [], []
        tail_s = np.zeros(0, np.int64)
        tail_i = np.zeros(0, np.int64)
        total = 0

        def tap(bs):
            nonlocal tail_s, tail_i, total
            for b in bs:
                if b.num_rows == 0:
                    continue
                s = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                i = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                need = window - sum(len(h) for h in head_i)
                if need > 0:
                    head_s.append(s[:need])
                    head_i.append(i[:need])
                tail_s = np.concatenate([tail_s, s])[-window:]
                tail_i = np.concatenate([tail_i, i])[-window:]
                total += len(i)
                yield b

        if inner is None:
            for _ in tap(batches):
                pass
        else:
            for out in inner(tap(batches)):
                yield _sorted_rows(0, pid, out.num_rows, bucket=out.column(0), packed=out.column(1))
        if total == 0:
            return
        hs = np.concatenate(head_s)
        hi = np.concatenate(head_i)
        h_idx = np.arange(len(hi))
        t_idx = np.arange(total - len(tail_i), total)
        keep = t_idx >= len(hi)                      # do not repeat head tokens
        idx = np.concatenate([h_idx, t_idx[keep]])
        yield _sorted_rows(1, pid, len(idx), idx=idx, seq_id=np.concatenate([hs, tail_s[keep]]),
                           w1=np.concatenate([hi, tail_i[keep]]))
        yield _sorted_rows(2, pid, 1, idx=[total])
    return f


def boundary_pairs_kernel(window: int, same_sequence: bool):
    """applyInArrow over one block of boundary tokens ``(pid, gpos, seq_id, id,
    own, block)`` with its right halo: pairs within ``window`` whose two tokens sit
    in different partitions and whose left token the block owns."""
    out = pa.schema([("w1", pa.int32()), ("w2", pa.int32()), ("x", pa.int64())])

    def f(t: pa.Table) -> pa.Table:
        if t.num_rows == 0:
            return out.empty_table()
        g = t.column("gpos").to_numpy()
        o = np.argsort(g, kind="stable")
        g = g[o]
        p = t.column("pid").to_numpy()[o]
        s = t.column("seq_id").to_numpy()[o]
        ids = t.column("w1").to_numpy().astype(np.int64)[o]
        mine = (t.column("own").to_numpy() == t.column("block").to_numpy())[o]
        n = len(g)
        keys = []
        for k in range(1, min(window, n - 1) + 1):
            ok = mine[:n - k] & (p[:n - k] != p[k:]) & (g[k:] - g[:n - k] <= window) & (ids[:n - k] != ids[k:])
            if same_sequence:
                ok &= s[:n - k] == s[k:]
            a, z = ids[:n - k][ok], ids[k:][ok]
            keys.append((np.minimum(a, z).astype(np.uint64) << np.uint64(32))
                        | np.maximum(a, z).astype(np.uint64))
        b = _count(keys)
        return pa.Table.from_batches([b]) if b is not None else out.empty_table()
    return f
