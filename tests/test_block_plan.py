"""The block plan in built-in functions: what goes from the JVM to the tasks' sums."""

import numpy as np
import pyarrow as pa
import pytest

from wordpair.operators import cooccur as co


def _stream(spark, n=400, seqs=7, ids=12):
    rng = np.random.default_rng(8)
    seq = np.sort(rng.integers(0, seqs, n))
    ids = rng.integers(1, ids, n)
    gap = np.cumsum(rng.integers(1, 4, n))   # positions may leave numbers out
    rows = list(zip(seq.tolist(), gap.tolist(), ids.tolist()))
    return rows, spark.createDataFrame(rows, "seq_id long, gp long, id int").repartition(4)


@pytest.mark.parametrize("window,boundary", [(1, "sequence"), (3, "stream"), (5, "sequence"), (7, "sequence"), (12, "stream")])
def test_any_window_and_gaps(spark, window, boundary):
    rows, pos = _stream(spark)
    want = {}
    for i, (s, g, w) in enumerate(rows):
        for t, h, u in rows[i + 1:i + 1 + window]:
            if h - g <= window and w != u and (s == t or boundary == "stream"):
                want[min(w, u), max(w, u)] = want.get((min(w, u), max(w, u)), 0) + 1
    got = co.window_pairs(pos, window, boundary, 16, "sql").collect()
    assert {(r.w1, r.w2): r.x for r in got} == want


def test_pairs_are_not_a_row_each(spark, monkeypatch):
    """a token's pairs go to the sums in a few rows."""
    rows, pos = _stream(spark)

    def count(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int32()),
                                          pa.array([b""], pa.binary())], names=["bucket", "packed"])
    monkeypatch.setattr(co, "count_kernel", count)
    sent = sum(r.bucket for r in co._block_counts(pos, 10, "sequence", 16, "sql").collect())
    assert sent == 2 * len(rows)
