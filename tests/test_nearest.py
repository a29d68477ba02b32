"""One-sided products and the search that skips cells."""

import numpy as np
import pytest

from wordpair.operators import scoring as sc
from wordpair.operators.nearest import build_cells, search
from wordpair.operators.scoring import ExpSum, TopK, one_sided


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, V, name, first=1):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(V, first)], f"id long, {name} array<double>")


def brute(V, Q, k, skip=None):
    S = Q @ V.T
    out = {}
    for q, s in enumerate(S):
        ids = [i for i in np.lexsort((np.arange(len(s)), -s)) if not skip or i + 1 not in skip[q]][:k]
        out[q] = [(int(i) + 1, round(float(s[i]), 9)) for i in ids]
    return out


def told(best):
    out = {}
    for r in sorted(best.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.id, round(r.score, 9)))
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = unit(rng.standard_normal((25, 16)))
    V = unit(np.repeat(centres, 40, axis=0) + 0.05 * rng.standard_normal((1000, 16)))
    V[10] = V[20] = V[30]                       # ties
    return V, unit(centres[:9] + 0.02 * rng.standard_normal((9, 16)))


def queries(spark, Q, skip):
    return spark.createDataFrame([(i, *skip[i], q.tolist()) for i, q in enumerate(Q)],
                                 "qid long, a_id int, b_id int, qn array<double>")


def test_pruned_search_is_exact_and_skips(spark, clustered):
    V, Q = clustered
    skip = {i: (40 * i + 1, 40 * i + 2) for i in range(len(Q))}
    cells = build_cells(frame(spark, V, "vn").repartition(3))
    best, work = search(cells, queries(spark, Q, skip), 5, ("a_id", "b_id"))
    assert told(best) == brute(V, Q, 5, skip)
    w = work.collect()
    assert len(w) == len(Q) and sum(r.searched for r in w) < 0.5 * sum(r.cells for r in w)


def test_pruned_search_of_random_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    V, Q = unit(rng.standard_normal((300, 5))), unit(rng.standard_normal((40, 5)))
    monkeypatch.setattr(sc, "QUERY_BYTES", 600)          # several blocks
    none = {i: (0, 0) for i in range(len(Q))}
    best, _ = search(build_cells(frame(spark, V, "vn"), n_cells=7), queries(spark, Q, none), 4, ("a_id", "b_id"))
    assert told(best) == brute(V, Q, 4)


def test_search_without_directions_words_or_enough_words(spark):
    V = np.array([[1.0, 0.0], [np.nan, np.nan], [0.0, 1.0]])
    q = spark.createDataFrame([(0, 1, 0, [1.0, 0.0]), (1, 0, 0, [float("nan")] * 2)],
                              "qid long, a_id int, b_id int, qn array<double>")
    best, work = search(build_cells(frame(spark, V, "vn")), q, 3, ("a_id", "b_id"))
    assert told(best) == {0: [(3, 0.0)]}
    assert {r.qid: r.searched > 0 for r in work.collect()} == {0: True, 1: False}
    empty = build_cells(frame(spark, V, "vn").limit(0))
    assert search(empty, q, 3)[0].count() == 0


def test_one_sided_products_move_no_vectors(spark, clustered, monkeypatch):
    V, Q = clustered
    monkeypatch.setattr(sc, "QUERY_BYTES", 300)
    monkeypatch.setattr(sc, "CELL_SCORES", 500)
    v = frame(spark, V, "v").repartition(4)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(Q)], "qid long, c array<double>")
    z = one_sided(v, q, ExpSum, ExpSum.schema, "z").groupBy("qid").sum("z").collect()
    assert {r[0]: r[1] for r in z} == pytest.approx(dict(enumerate(np.exp(Q @ V.T).sum(axis=1))))
    top = one_sided(v, q, lambda b: TopK(b, 3), TopK.schema, "top")
    from wordpair.operators.analogy import ranked
    assert told(ranked(top, 3)) == brute(V, Q, 3)
    assert one_sided(v, q.limit(0), ExpSum, ExpSum.schema, "z").count() == 0
    assert one_sided(v.limit(0), q, ExpSum, ExpSum.schema, "z").count() == 0
