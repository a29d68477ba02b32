"""Pairs meet vectors: what is copied, what a task holds, and what stays on disk."""

import glob
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordpair import session
from wordpair.operators import pair_blocks, train as tr
from wordpair.operators.model import sn_gradient, sn_loss
from wordpair.operators.pmi import pmi_scatter
from wordpair.operators.train import train_minibatch
from wordpair.plans import catalog


def _vectors(spark, V):
    return spark.createDataFrame([(i + 1, V[i].tolist()) for i in range(len(V))], "id int, v array<double>")


def test_a_task_holds_a_block_and_few_copies_are_made(spark, monkeypatch):
    """a block of vectors and a chunk fit their limits; a word is copied to the blocks
    of its partners w2, of which there are as few as memory allows, and to its own."""
    n, d = 200, 4
    monkeypatch.setattr(pair_blocks, "TASK_BYTES", 40 * d * 8)
    monkeypatch.setattr(pair_blocks, "CHUNK_BYTES", 25 * d * 8)
    R, C, K = pair_blocks.grid_for(n, d)
    assert (R, C, K) == (5, 1, 8)
    rng = np.random.default_rng(0)
    # a word's partners are rarer, most words have few
    pairs = sorted({(i, int(j)) for i in range(1, n) for j in rng.integers(i + 1, n + 1, 400 // i + 2)})
    frame = spark.createDataFrame([(a, b, 1) for a, b in pairs], "w1 int, w2 int, x long")

    def kernel(vt, xt):
        rows = [r for *_, some in pair_blocks.pair_chunks(vt, xt) for r in some]
        assert len(rows) == xt.num_rows
        return pa.table({"block": [int(vt.right.ids[0] % R)], "chunk": [int(vt.left.ids[0] % K)],
                         "left": [len(vt.left.ids)], "right": [len(vt.right.ids)], "n": [len(rows)]})

    got = pair_blocks.with_vectors(frame, _vectors(spark, np.ones((n, d))), kernel,
                                   "block long, chunk long, left long, right long, n long").collect()
    assert sum(r["n"] for r in got) == len(pairs)
    assert max(r["right"] for r in got) <= 40 and max(r["left"] for r in got) <= 25
    copies = sum(r["left"] for r in got) + sum({r["block"]: r["right"] for r in got}.values())
    assert copies == len({(a, b % R) for a, b in pairs}) + len({b for _, b in pairs})
    # blocks for both ends at once have to be half as large, and a word meets those of all partners
    P = 2 * R
    assert copies < 0.6 * len({(a, b % P) for a, b in pairs} | {(b, a % P) for a, b in pairs})


@pytest.mark.parametrize("small", [False, True])
def test_sums_of_many_blocks_and_chunks(spark, monkeypatch, small):
    """Any order of ids, ids that repeat, are far apart or unknown."""
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.arange(1, 30), [10 ** 9, 2 * 10 ** 9 + 7, -5]])
    V = rng.standard_normal((len(ids), 3))
    pairs = [(int(a), int(b), int(x)) for a, b, x in zip(rng.choice(ids, 300), rng.choice(ids, 300), rng.integers(1, 90, 300))]
    frame = spark.createDataFrame(pairs + [(1, 77, 3), (78, 2, 3), (None, 2, 5), (4, None, 5)], "w1 int, w2 int, x long")
    vec = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, V)] + [(None, [0.0] * 3), (7, V[6].tolist())],
                                "id int, v array<double>")
    if small:
        for name, value in (("TASK_BYTES", 400), ("CHUNK_BYTES", 200), ("MEET_ROWS", 10), ("PACK_ROWS", 40),
                            ("CHUNK_NUMBERS", 12), ("MASK_BITS", 3)):
            monkeypatch.setattr(pair_blocks, name, value)
    row = {int(i): v for i, v in zip(ids, V)}
    loss, grad = 0.0, {}
    for a, b, x in pairs:
        vs = row[a] + row[b]
        r = np.log(x) - vs @ vs - 0.3
        loss += min(x, 50.0) * r * r
        for w in (a, b):
            grad[w] = grad.get(w, 0) - 4 * min(x, 50.0) * r * vs
    assert sn_loss(frame, vec, 0.3, 50.0).first().loss == pytest.approx(loss, rel=1e-9)
    got = {r.id: r.g for r in sn_gradient(frame, vec, 0.3, 50.0).collect()}
    assert got.keys() == grad.keys() and all(np.allclose(got[w], grad[w]) for w in grad)


def _tables(spark):
    return {os.path.basename(p).rsplit("-", 1)[0]: p for p in glob.glob(f"{_folder(spark)}/wordpair-*")}


def _folder(spark):
    return session.ensure_checkpoint_dir(spark).removeprefix("file:")


@pytest.fixture
def corpus(spark, tmp_path, monkeypatch):
    """Documents and embeddings, and an empty folder for scratch tables."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), 30)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, rng.standard_normal(8).astype(float).tolist()) for i in range(5)],
                          "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = session.checkpoint_dir(spark)
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/scratch")
    yield str(tmp_path)
    spark.sparkContext.setCheckpointDir(before)


@pytest.mark.parametrize("query", [catalog.q_gamma, catalog.q_pmi_scatter_documents])
def test_pairs_go_once_their_pmi_is_stored(spark, corpus, query):
    """the table of pairs and that of their PMI are deleted as soon as nothing reads them."""
    out = query(spark, corpus)
    assert out.count() > 0
    assert {"wordpair-pairs", "wordpair-pmi"}.isdisjoint(_tables(spark)) and "wordpair-scatter" in _tables(spark)


def test_pmi_scatter_leaves_the_pairs_of_others(spark, corpus):
    pairs, vec = catalog._real(spark, corpus)
    pmi_scatter(vec, pairs, None, 1)
    assert "wordpair-pairs" in _tables(spark) and pairs.count() > 0


def test_stored_pairs_are_not_stored_again_by_batch(spark, corpus, monkeypatch):
    """few steps read a stored table of pairs again; it goes when the fit is over."""
    stored = []
    monkeypatch.setattr(tr, "materialize", lambda df, label, **kw: stored.append(label) or session.materialize(df, label, **kw))
    assert catalog.q_fit_documents(spark, corpus).count() == 1
    assert stored == ["params", "params"]
    assert {"wordpair-pairs", "wordpair-pmi", "wordpair-batches"}.isdisjoint(_tables(spark))


def test_batches_of_stored_pairs_are_those_of_any_pairs(spark, corpus, monkeypatch):
    pairs = session.materialize(spark.createDataFrame([(i, j, i + j) for i in range(1, 9) for j in range(i + 1, 9)]
                                                      + [(1, None, 2)], "w1 int, w2 int, x long"), "pairs")
    params = _vectors(spark, np.random.default_rng(2).random((8, 3))).withColumn("gacc", F.transform("v", lambda x: x * 0))
    got = [train_minibatch(p, params, 1.0, n_batches=2, epochs=e)[2][:4]
           for p, e in ((pairs, 2), (pairs, 3), (pairs.select("*"), 2))]
    assert len(got[0]) == 4
    for other in got[1:]:
        assert np.allclose(np.array(other), np.array(got[0]), rtol=1e-9)


def test_shuffle_files_of_stored_tables_go(spark, monkeypatch):
    """Files that only a stored table's job needed do not stay until the end."""
    monkeypatch.setattr(session, "SWEEP_SECONDS", 0.0)
    where = spark.conf.get("spark.local.dir", "/tmp")

    def files():
        return set(glob.glob(f"{where}/blockmgr-*/*/shuffle_*.data"))
    before = files()
    out = session.materialize(spark.range(1000).repartition(3).groupBy("id").count(), "groups")
    until = time.monotonic() + 30
    while files() - before and time.monotonic() < until:
        session.sweep(spark)
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 1000
