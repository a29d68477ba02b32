import math
from collections import Counter, defaultdict

from wordpair.llm import mixing


def words(t):
    return len((t or "").encode().split())


def shares(sizes, weights=(5, 2, 1), cap=3.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        left = total - sum(target.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if got[s] > cap * sizes[s]]
        if not above:
            return target | got
        target |= {s: cap * sizes[s] for s in above}


def check(rows, slack):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = shares(sizes)
    taken, most = Counter(), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(slack * t, most[s] / 2 + 1), (s, taken[s], t)


def test_odd_rows(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r.doc_id or -1, r.size) for r in rows) == \
        sorted((r.doc_id or -1, words(r.text)) for r in odd_docs.collect())
    check(rows, 0.05)


def test_rates_are_tilted_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"src{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(docs).collect()
    check(out, 0.01)
    by_source = defaultdict(list)
    for r in out:
        by_source[r.source].append((r.size, r.rate))
    for s, pairs in by_source.items():
        # ln(rate) is linear in the size where the cap does not bind
        lam = {round(math.log(r) / x, 9) for x, r in pairs if r < 3}
        assert len(lam) <= 1, s
        total = sum(x * r for x, r in pairs)
        target = next(r.target for r in out if r.source == s)
        assert abs(total - target) <= max(1.0, 1e-6 * target)
    again = mixing.mix(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_identical_rows_do_not_fall_together(spark):
    rows = [(1, "same words here", "a")] * 300 + [(i, "x y z", "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    check(mixing.mix(docs).collect(), 0.02)


def test_mixed_repeats_rows(odd_docs):
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    took = Counter((r.doc_id, words(r.text)) for r in out.collect())
    want = Counter()
    for r in mixing.mix(odd_docs).collect():
        want[r.doc_id, r.size] += r.copies
    assert took == +want


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0
