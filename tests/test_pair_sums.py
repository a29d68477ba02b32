"""Partial sums of pairs: what goes through the shuffle, and what comes back."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordpair.operators import pair_blocks, pair_sums
from wordpair.operators.cooccur import cooccurrence, merge_counts
from wordpair.operators.pairs_arrow import window_pairs_kernel
from wordpair.plans import catalog
from wordpair.sources.corpus import document_tokens


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _added_up(rows):
    """Packed rows of several tasks, in order of bucket as the shuffle leaves them."""
    t = pa.Table.from_batches(rows).sort_by("bucket")
    out = {}
    for b in pair_sums.add_up_kernel(iter(t.to_batches(max_chunksize=100))):
        for r in b.to_pylist():
            assert (r["w1"], r["w2"]) not in out
            out[(r["w1"], r["w2"])] = r["x"]
    return out


def test_sums_of_several_chunks_come_back(monkeypatch):
    monkeypatch.setattr(pair_sums, "MERGE_KEYS", 50)
    rng = np.random.default_rng(5)
    w1, w2 = rng.integers(1, 40, 600), rng.integers(1, 40, 600) * 50_000_000
    x = rng.integers(1, 1 << 40, 600)
    batches = [pa.RecordBatch.from_arrays([pa.array(w1[a:a + 70].astype(np.int32)), pa.array(w2[a:a + 70].astype(np.int32)),
                                           pa.array(x[a:a + 70])], names=["w1", "w2", "x"]) for a in range(0, 600, 70)]
    want = {}
    for a, b, c in zip(w1.tolist(), w2.astype(np.int32).tolist(), x.tolist()):
        want[(a, b)] = want.get((a, b), 0) + c
    packed = list(pair_sums.pack_kernel(iter(batches)))
    assert len(packed) > 1
    assert _added_up(packed) == want


def test_merge_counts_keeps_nulls_and_any_ids(spark):
    rows = [(1, 2, 4), (1, 2, 5), (None, 2, 1), (None, 2, 2), (1, None, None), (7, 3, -2), (-1, -5, 3), (-1, -5, 1),
            (2, 2, 0), (None, None, 6), (1, 2, None), (5, 0, None), (5, 0, 2), (3, 4, None)]
    df = spark.createDataFrame(rows, "w1 int, w2 int, x long")
    got = {(r.w1, r.w2): r.x for r in merge_counts(df.repartition(3), df).collect()}
    want = {(r.w1, r.w2): r.x for r in df.unionByName(df).groupBy("w1", "w2").agg(F.sum("x").alias("x")).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_a_kernel_holds_a_chunk_only(chunk):
    """Whatever comes in, partial sums go out every ``chunk`` pairs."""
    rng = np.random.default_rng(9)
    ids, seq = rng.integers(1, 20, 300), np.repeat(np.arange(6), 50)
    batch = pa.RecordBatch.from_arrays([pa.array(seq), pa.array(ids.astype(np.int32))], names=["seq_id", "id"])
    rows = list(window_pairs_kernel(4, True, chunk)(iter([batch.slice(0, 130), batch.slice(130, 0), batch.slice(130)])))
    want = {}
    for i in range(300):
        for j in range(i + 1, min(i + 5, 300)):
            if seq[i] == seq[j] and ids[i] != ids[j]:
                k = (int(min(ids[i], ids[j])), int(max(ids[i], ids[j])))
                want[k] = want.get(k, 0) + 1
    assert _added_up(rows) == want
    assert (len(rows) == 1) == (chunk == 1 << 20)


def test_partial_sums_take_a_few_bytes():
    rng = np.random.default_rng(2)
    keys = pair_sums.high_bits(rng.integers(1, 300_000, 1_000_000)) | rng.integers(1, 50_000, 1_000_000).astype(np.uint64)
    k, x = pair_sums.reduced(keys)
    assert pair_sums.packed(k, x).nbytes < 4.5 * len(k)   # a row of three numbers: 16 and more


def test_pairs_are_not_shuffled_as_rows(spark):
    docs = spark.createDataFrame([(k, "a b c a d e f a b") for k in range(20)], "doc_id long, text string")
    vocab = spark.createDataFrame([(i + 1, w, 5) for i, w in enumerate("abcdef")], "id int, word string, count long")
    plan = _plan(cooccurrence(document_tokens(docs), vocab, 3))
    assert "hashpartitioning(w1" not in plan and "hashpartitioning(bucket" in plan

    pairs = spark.createDataFrame([(1, 2, 4), (1, 3, 1), (2, 3, 2), (2, 900, 1)], "w1 int, w2 int, x long")
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in (1, 2, 3, 900)], "id int, v array<double>")

    def kernel(vt, xt):
        n = sum(len(rows) for *_, rows in pair_blocks.pair_chunks(vt, xt))
        return pa.table({"n": pa.array([n], pa.int64())})
    met = pair_blocks.with_vectors(pairs, vec, kernel, "n long", blocks=130)
    assert met.agg(F.sum("n")).first()[0] == 4
    plan = _plan(met)
    assert "collect_set" not in plan and "rows#" in plan


def test_sums_of_any_size_come_back():
    """Keys and counts that do not fit one number, and negative counts."""
    rng = np.random.default_rng(7)
    for top, low in ((1 << 10, 1), (1 << 40, 1), (1 << 10, -5)):
        keys = rng.integers(0, 1 << 52, 300, dtype=np.uint64)[rng.integers(0, 300, 900)]
        counts = rng.integers(low, top, 900)
        want = {}
        for k, x in zip(keys.tolist(), counts.tolist()):
            want[k] = want.get(k, 0) + x
        k, x = pair_sums._summed_bucket(keys, counts)
        assert k.tolist() == sorted(want) and dict(zip(k.tolist(), x.tolist())) == want


def _sums(df):
    return {(r.w1, r.w2): r.x for r in df.collect()}


@pytest.mark.parametrize("method", ["scan", "sorted", "blocks"])
def test_packed_counts_are_merged_with_rows(spark, method):
    vocab = spark.createDataFrame([(i + 1, w, 5) for i, w in enumerate("abcdef")], "id int, word string, count long")
    one, two = (document_tokens(spark.createDataFrame(rows, "doc_id long, text string")) for rows in
                ([(k, "a b c a d") for k in range(9)], [(k, "f e d c") for k in range(5)] + [(7, None)]))
    rows = spark.createDataFrame([(1, 2, 100), (None, 2, 1), (3, 6, None)], "w1 int, w2 int, x long")
    counts = [cooccurrence(t, vocab, 3, method=method, packed=True) for t in (one, two)]
    want = cooccurrence(one, vocab, 3).unionByName(cooccurrence(two, vocab, 3)).unionByName(rows) \
        .groupBy("w1", "w2").agg(F.sum("x").alias("x"))
    assert _sums(merge_counts(*counts, rows)) == _sums(want)
    assert _sums(merge_counts(counts[0])) == _sums(cooccurrence(one, vocab, 3))


def test_halves_are_shuffled_and_added_up_once(spark, tmp_path):
    """merged_pairs_documents: the halves' sums do not become rows before they are merged."""
    rows = [(k, "a b c a d e f a b") for k in range(20)] + [(3, "b a f"), (4, None), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    merged = catalog.q_merged_pairs_documents(spark, str(tmp_path))
    assert _plan(merged).count("hashpartitioning(bucket") == 1
    kept = document_tokens(docs.where("doc_id is not null"))
    assert _sums(merged) == _sums(cooccurrence(kept, catalog.doc_vocab(spark, str(tmp_path)), catalog.WINDOW))
