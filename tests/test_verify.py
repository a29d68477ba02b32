"""Diagnostics D1-D4, D6, D8 against numpy on small vector tables."""

import numpy as np
import pytest

from wordpair.operators.diagnostics import (histogram, norm_vs_frequency, partition_function,
                                            relation_directions, relation_pairs, singular_values)
from wordpair.operators.pmi import pmi_scatter


def _vectors(spark, V, counts=None):
    n = len(V)
    counts = counts if counts is not None else [100 // (i + 1) + 1 for i in range(n)]
    return spark.createDataFrame([(i + 1, f"w{i + 1}", int(counts[i]), V[i].tolist()) for i in range(n)],
                                 "id int, word string, count long, v array<double>")


@pytest.fixture(scope="module")
def V():
    return np.random.default_rng(0).normal(size=(30, 16)) * 0.3


def test_partition_function_random_directions(spark, V):
    detail, summary = partition_function(_vectors(spark, V), n_samples=200, seed=0)
    z = np.array([r.z for r in detail.collect()])
    assert len(z) == 200 and (z > 0).all()
    nz = z / z.mean()
    assert 0.1 < nz.min() < nz.max() < 10
    s = summary.first()
    assert s.n == 200 and s.c_norm == pytest.approx(4 / np.linalg.norm(V, axis=1).mean())


def test_partition_function_given_directions_matches_numpy(spark, V):
    D = np.random.default_rng(1).normal(size=(7, 16))
    dirs = spark.createDataFrame([(t, D[t].tolist()) for t in range(7)], "t long, c array<double>")
    scale = 4 / np.linalg.norm(V, axis=1).mean()
    got = {r.s: r.z for r in partition_function(_vectors(spark, V), dirs, id_col="t", dir_col="c")[0].collect()}
    for t in range(7):
        c = D[t] / np.linalg.norm(D[t]) * scale
        assert got[t] == pytest.approx(np.exp(V @ c).sum(), rel=1e-10)
    # along a path (D8): unit contexts are only scaled
    U = D / np.linalg.norm(D, axis=1, keepdims=True)
    path = spark.createDataFrame([(t, U[t].tolist()) for t in range(7)], "t long, c array<double>")
    got8 = {r.s: r.z for r in partition_function(_vectors(spark, V), path, renormalize=False,
                                                 id_col="t", dir_col="c")[0].collect()}
    for t in range(7):
        assert got8[t] == pytest.approx(got[t], rel=1e-10)


def test_histogram_counts(spark):
    df = spark.createDataFrame([(float(x),) for x in [0.0, 0.5, 1.0, 1.0, 2.0]], "x double")
    h = {r.bin: r["count"] for r in histogram(df, "x", 4).collect()}
    assert h == {1: 1, 2: 1, 3: 2, 4: 1}


def test_norm_vs_frequency(spark, V):
    counts = [int(c) for c in np.random.default_rng(5).integers(1, 1000, len(V))]
    detail, summary = norm_vs_frequency(_vectors(spark, V, counts))
    rows = sorted(detail.collect(), key=lambda r: r.id)
    sq = (V ** 2).sum(1)
    lf = np.log(np.array(counts) / sum(counts))
    assert np.allclose([r.sq_norm for r in rows], sq)
    assert np.allclose([r.log_freq for r in rows], lf)
    assert summary.first().correlation == pytest.approx(np.corrcoef(sq, lf)[0, 1])


@pytest.mark.parametrize("shape", [(30, 16), (5, 16)])
def test_singular_values_match_numpy(spark, shape):
    M = np.random.default_rng(2).normal(size=shape)
    vec = _vectors(spark, M).repartition(3)
    sv, summary = singular_values(vec, fanout=2)
    got = np.array([r.sigma for r in sv.orderBy("k").collect()])
    ref = np.linalg.svd(M, compute_uv=False)
    assert np.allclose(got, ref)
    assert all(np.diff(got) <= 1e-12)
    s = summary.first()
    rms = np.sqrt((ref ** 2).mean())
    assert s.rms == pytest.approx(rms) and 0 < s.ratio <= 1
    assert s.ratio == pytest.approx(ref[ref > 1e-10 * rms].min() / rms)


def test_pmi_scatter(spark, V):
    rng = np.random.default_rng(3)
    pairs = [(i, j, int(rng.integers(1, 30))) for i in range(1, 31) for j in range(i + 1, 31)
             if rng.random() < 0.5]
    pr = spark.createDataFrame(pairs, "w1 int, w2 int, x long")
    detail, summary = pmi_scatter(_vectors(spark, V), pr, n_samples=50, x_floor=1, seed=0)
    rows = detail.collect()
    assert len(rows) == 50
    for r in rows[:10]:
        assert r.pmi_pred == pytest.approx(V[r.w1 - 1] @ V[r.w2 - 1])
    assert np.isfinite([r.pmi_emp for r in rows]).all()
    assert np.isfinite(summary.first().slope)


def test_relation_directions_match_numpy_svd(spark, V):
    qs = [("r1", f"w{a}", f"w{b}", "w1", "w2") for a, b in [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (1, 2)]]
    qs += [("r2", f"w{a}", f"w{b}", "w1", "w2") for a, b in [(11, 12), (13, 14), (15, 16)]]   # < min_pairs
    questions = spark.createDataFrame(qs, "relation string, a string, b string, c string, d string")
    vec = _vectors(spark, V)
    rp = relation_pairs(vec, questions).select("relation", "n_pairs").distinct().collect()
    assert [(r.relation, r.n_pairs) for r in rp] == [("r1", 6)]
    got = relation_directions(vec, questions, min_pairs=5).first()
    M = np.stack([V[a - 1] - V[b - 1] for a, b in [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (1, 2)]], 1)
    U, _, _ = np.linalg.svd(M, full_matrices=False)
    c1 = (M.T @ U[:, 0]) / np.linalg.norm(M, axis=0)
    c2 = (M.T @ U[:, 1]) / np.linalg.norm(M, axis=0)
    if c1.mean() < 0:
        c1 = -c1
    assert got.n_pairs == 6
    assert got.mean1 == pytest.approx(c1.mean()) and got.std1 == pytest.approx(c1.std(ddof=1))
    assert abs(got.mean2) == pytest.approx(abs(c2.mean())) and got.std2 == pytest.approx(c2.std(ddof=1))
