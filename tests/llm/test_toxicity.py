import numpy as np

from wordpair.llm import toxicity as tx

BAD = ["grubble", "snarfle", "vexmont"]
GOOD = ["river", "lantern", "meadow", "copper", "window", "harbour", "cedar", "violet"]


def make(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        w = list(rng.choice(GOOD, 30))
        if y:
            w[int(rng.integers(30))] = BAD[int(rng.integers(3))] + ("ing" if rng.random() < 0.5 else "")
        rows.append((seed * 1000 + i, " ".join(w), y))
    return rows


def test_learns_and_generalises(spark):
    train, test = make(300, 1), make(100, 2)
    docs = spark.createDataFrame([r[:2] for r in train + test], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in train], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels)
    got = {r.doc_id: r.toxic_score for r in tx.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in test]
    assert np.mean(right) >= 0.97
    # labels, and so anything but the text, are no input of a score
    same = {r.text: r.toxic_score for r in tx.score(docs.select("text"), model).collect()}
    assert all(abs(same[t] - got[i]) < 1e-12 for i, t, _ in test)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(10, 1), (10, 1), (12, 0), (17, None), (15, 7), (None, 1), (999, 1)],
                                   "doc_id long, toxic int")
    model = tx.fit(odd_docs, labels)
    out = tx.score(odd_docs, model)
    assert out.columns == [c for c in odd_docs.columns if c != "toxic_score"] + ["toxic_score"]
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.toxic_score <= 1 for r in rows)
    blank = {round(r.toxic_score, 12) for r in rows if not (r.text or "").strip()}
    assert len(blank) == 1
    assert tx.score(no_docs, model).count() == 0


def test_no_labels(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(odd_docs, labels)
    assert {r.toxic_score for r in tx.score(odd_docs, model).collect()} == {0.5}


def test_gradient(spark, monkeypatch):
    monkeypatch.setattr(tx, "BITS", 6)
    rng = np.random.default_rng(0)
    rows = [(str(i % 2), bytearray(tx.pack_buckets(np.sort(rng.choice(64, 9, replace=False)))))
            for i in range(10)]
    sample = spark.createDataFrame(rows, "label string, counts binary").repartition(3)
    f = tx._loss_grad(sample, rng.standard_normal(64), {0: 5, 1: 5}, 0.01)
    x = rng.standard_normal(65)
    loss, grad = f(x)
    for j in (0, 7, 33, 64):
        e = np.zeros(65)
        e[j] = 1e-3
        assert abs((f(x + e)[0] - f(x - e)[0]) / 2e-3 - grad[j]) < 1e-3


def test_buckets_are_packed_and_unpacked():
    for found in ([], [0], [5, 6, 70_000], [0, 200_000], [3, 65_538, 65_539]):
        assert tx.unpack_buckets(tx.pack_buckets(np.array(found, np.int64))).tolist() == found


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    b = np.array([1.0, -2.0, 3.0])
    x = tx.lbfgs(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(3), steps=100, tol=1e-9)
    assert np.allclose(x, b / np.diag(a), atol=1e-3)


def test_scores_use_the_whole_text(spark):
    docs = spark.createDataFrame([r[:2] for r in make(200, 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in make(200, 3)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    clean = "river lantern meadow copper " * 50_000
    both = spark.createDataFrame([(1, clean), (2, clean + "grubble snarfle vexmont")], "doc_id long, text string")
    a, b = [r.toxic_score for r in tx.score(both, model).orderBy("doc_id").collect()]
    assert a < b


def plain_scores(train, texts, buckets, l2=1e-4):
    """The classifier without any of its helpers: presence of hashed n-grams, log-count
    ratios, Newton's method on the balanced logistic loss."""
    def grams(text):
        b = (" " + " ".join((text or "").lower().split()) + " ").encode()
        out = set()
        for n in (3, 4, 5):
            for i in range(len(b) - n + 1):
                number = int.from_bytes(b[i:i + n], "little") + n
                out.add((number * 0x9E3779B97F4A7C15) % 2 ** 64 >> (64 - buckets.bit_length() + 1))
        return sorted(out)

    count = {0: np.ones(buckets), 1: np.ones(buckets)}
    for text, y in train:
        count[y][grams(text)] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    X = np.zeros((len(train), buckets + 1))
    for row, (text, _) in zip(X, train, strict=True):
        row[grams(text)] = 1
    X[:, :-1] *= ratio
    X[:, -1] = 1
    y = np.array([1 if y else -1 for _, y in train])
    c = 0.5 / np.array([sum(t[1] == v for t in train) for _, v in train])

    def loss(w):
        return float((c * np.logaddexp(0, -y * (X @ w))).sum() + 0.5 * l2 * (w[:-1] @ w[:-1]))

    w = np.zeros(buckets + 1)
    ridge = np.full(buckets + 1, l2)
    ridge[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(y * (X @ w)))
        gradient = -(X.T @ (c * y * p)) + ridge * w
        hessian = (X.T * (c * p * (1 - p))) @ X + np.diag(ridge + 1e-12)
        w -= np.linalg.solve(hessian, gradient)

    def scores(by_bucket, bias):
        return np.array([1 / (1 + np.exp(-(by_bucket[grams(t)].sum() + bias))) for t in texts])

    return ratio, w, loss, scores


def test_scores_against_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(tx, "BITS", 9)
    rows = make(60, 5)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, ""), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    weights, bias = tx.fit(docs.repartition(3), labels)
    ratio, w, loss, scores = plain_scores([(t, y) for _, t, y in rows], [r[1] for r in rows] + ["", None], 1 << 9)
    got = {r.doc_id: r.toxic_score for r in tx.score(docs, (weights, bias)).collect()}
    got = np.array([got[r[0]] for r in rows] + [got[1], got[2]])
    # a score is the logistic function of the weights of the text's n-grams
    assert np.abs(got - scores(weights, bias)).max() < 1e-5
    # L-BFGS stops near the minimum that Newton's method reaches
    mine = np.append(weights / np.where(ratio == 0, 1, ratio), bias)
    assert loss(w) - 1e-9 <= loss(mine) <= loss(w) + 2e-3
    want = scores(w[:-1] * ratio, w[-1])[:len(rows)]
    assert np.abs(got[:len(rows)] - want).max() < 0.02 and ((got[:len(rows)] >= 0.5) == (want >= 0.5)).all()
