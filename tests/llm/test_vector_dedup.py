import numpy as np
import pytest

from wordpair.llm import vector_dedup as vd


def brute(rows, threshold=0.98):
    def fit(v, label):
        return (label is not None and v is not None and len(v) and None not in v
                and np.isfinite(v).all() and np.any(v))
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if fit(v, lb) else None for _, v, lb in rows]
    up, deg = list(range(n)), [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] \
                    and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                deg[i] += 1
                deg[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(least.get(root(i), v), v)
    return sorted(((rows[i][0], deg[i], least.get(root(i)), rows[i][0] == least.get(root(i)))
                   for i in range(n)), key=str)


def frame(spark, rows):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], lb, 1, "f")
            for i, v, lb in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, key int, filter string")


def clusters(seed=0, d=32):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        for _ in range(12):
            noise = rng.standard_normal(d)
            noise -= noise @ centre * centre
            noise *= rng.uniform(0.02, 0.2) / np.linalg.norm(noise)
            rows.append((len(rows), (centre + noise).astype(np.float32).tolist(), c % 2))
    rows += [(len(rows) + i, rng.standard_normal(d).astype(np.float32).tolist(), i % 2) for i in range(60)]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)]
    return rows


ODD = [(300, None, 1), (301, [], 1), (302, [0.0] * 32, 1), (303, [1.0] * 31 + [None], 1),
       (304, [float("nan")] * 32, 1), (305, [float("inf")] + [0.0] * 31, 1), (306, [1.0] * 32, None),
       (307, [1.0] * 32, 5), (307, [1.0] * 32, 5), (None, [1.0] * 32, 5), (308, [2.0] * 32, 5),
       (309, [1.0] * 3, 5), (310, [1.0, 1.0, 1.0], 5), (None, [0.5, -0.5], 7)]


def test_against_all_pairs(spark):
    rows = clusters() + ODD
    got = vd.vector_classes(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_large_filters_are_split(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK", 4)
    monkeypatch.setattr(vd, "GROUP_ROWS", 16)
    rows = clusters(1)
    got = vd.vector_classes(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert vd.vector_classes(frame(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_recall_at_the_threshold(dim):
    rng = np.random.default_rng(3)
    code = vd.ProductCode(dim, vd.BLOCKS, 64, 7)
    a = rng.standard_normal((2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b
    pairs = zip(code.decode(a, vd.MARGIN), code.decode(b, vd.MARGIN), strict=True)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in pairs]) >= 0.99


@pytest.mark.parametrize("n", [100, 50_000, 2_000_000, 30_000_000])
def test_recall_and_filters_at_every_size(n):
    """Directions follow the size: recall stays, filters a vector grow like their root."""
    rng = np.random.default_rng(4)
    size = vd.code_for(n)
    assert size == vd.LEAST_CODE or abs(size ** 3 / n - vd.FILTERS_A_VECTOR) < 0.3 * vd.FILTERS_A_VECTOR
    code = vd.ProductCode(64, vd.BLOCKS, size, 7)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b
    x, y = code.decode(a, vd.MARGIN), code.decode(b, vd.MARGIN)
    recall, passed = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)]), np.mean([len(p) for p in x])
    print("RECALL", n, size, recall, passed)
    assert recall >= 0.99 and passed <= 2.2 * size ** 0.5


@pytest.mark.parametrize("dim", [16, 64, 256])
@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.8])
def test_recall_at_lower_thresholds(dim, threshold):
    rng = np.random.default_rng(3)
    code = vd.ProductCode(dim, vd.BLOCKS, 64, 7)
    a = rng.standard_normal((300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + np.sqrt(1 - threshold ** 2) * b
    margin = vd.margin_for(threshold, dim)
    pairs = zip(code.decode(a, margin), code.decode(b, margin), strict=True)
    recall = np.mean([len(np.intersect1d(x, y)) > 0 for x, y in pairs])
    print("RECALL", threshold, dim, round(margin, 3), round(recall, 4))
    assert recall >= 0.99
