"""Emission probabilities (D10) and Gumbel-max draws."""

import numpy as np
import pytest

from wordpair.operators.emission import emission_probs, sample_emissions


def _vectors(spark, V):
    return spark.createDataFrame([(i + 1, f"w{i + 1}", 1, V[i].tolist()) for i in range(len(V))],
                                 "id int, word string, count long, v array<double>")


def test_emission_probs_match_softmax(spark):
    rng = np.random.default_rng(0)
    V = rng.normal(size=(40, 8))
    C = rng.normal(size=(5, 8))
    C /= np.linalg.norm(C, axis=1, keepdims=True)
    ctx = spark.createDataFrame([(t, C[t].tolist()) for t in range(5)], "t long, c array<double>")
    got = emission_probs(_vectors(spark, V), ctx, k=3).collect()
    scale = 4 / np.linalg.norm(V, axis=1).mean()
    for t in range(5):
        lg = V @ (C[t] * scale)
        p = np.exp(lg - lg.max())
        p /= p.sum()
        top = np.argsort(-p, kind="stable")[:3]
        rows = sorted([r for r in got if r.t == t], key=lambda r: r.rank)
        assert [r.id for r in rows] == [int(i) + 1 for i in top]
        assert np.allclose([r.p for r in rows], p[top])


def test_gumbel_draw_frequencies(spark):
    V = np.array([[0.0, 0.0], [0.5, 0.0], [1.0, 0.0], [0.0, 0.7], [-0.4, 0.2]])
    n = 4000
    ctx = spark.createDataFrame([(t, [1.0, 0.0]) for t in range(n)], "t long, c array<double>")
    draws = sample_emissions(_vectors(spark, V), ctx, seed=3).groupBy("id").count().collect()
    freq = np.zeros(5)
    for r in draws:
        freq[r.id - 1] = r["count"]
    scale = 4 / np.linalg.norm(V, axis=1).mean()
    lg = V @ np.array([scale, 0.0])
    p = np.exp(lg - lg.max())
    p /= p.sum()
    chi2 = ((freq - n * p) ** 2 / (n * p)).sum()
    assert chi2 < 20.5   # 4 d.o.f., p ~ 0.0004
    again = sample_emissions(_vectors(spark, V).repartition(3), ctx, seed=3)
    assert again.exceptAll(sample_emissions(_vectors(spark, V), ctx, seed=3)).count() == 0


def test_draws_take_no_logarithms_where_a_word_cannot_win(monkeypatch):
    """The same draws as with noise for every word, of which few are worked out."""
    from wordpair.operators import scoring as sc
    rng = np.random.default_rng(4)
    n, q = 6000, 40
    V, Q = rng.normal(size=(n, 8)), rng.normal(size=(q, 8))
    V[17, 2], V[1800, 1] = np.nan, np.inf
    ids = rng.permutation(n) + 1
    block = object.__new__(sc.Block)
    block.qid, block.Q, block.more = np.arange(q) * 7, Q, {}
    seen = []
    real = sc.as_uniform
    monkeypatch.setattr(sc, "as_uniform", lambda bits: (seen.append(bits.size), real(bits))[1])
    draw = sc.GumbelMax(block, 11)
    for at in range(0, n, 2500):
        order = np.argsort(ids[at:at + 2500])
        draw.add(ids[at:at + 2500][order], V[at:at + 2500][order])
    got = {r["qid"]: (r["id"], r["score"]) for r in draw.table().to_pylist()}
    worked_out = sum(seen)
    u = sc.uniform01(11, block.qid[None, :].repeat(n, 0), ids[:, None].repeat(q, 1))
    with np.errstate(invalid="ignore"):
        scores = V @ Q.T - np.log(-np.log(u))
    scores[np.isnan(scores)] = -np.inf
    best = scores.argmax(axis=0)
    assert {k: v[0] for k, v in got.items()} == dict(zip((np.arange(q) * 7).tolist(), ids[best].tolist()))
    assert np.allclose([got[k][1] for k in block.qid.tolist()], scores[best, np.arange(q)])
    assert worked_out < 0.5 * n * q
