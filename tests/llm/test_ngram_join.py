import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from wordpair.llm import memory
from wordpair.llm import ngram_join as nj
from wordpair.llm.shingles import shingle_hashes, word_hashes


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=75):
    """rows of (doc_id, text) -> sorted (doc_id, n, component)."""
    sets = [shingles(t) for _, t in rows]
    lists = defaultdict(list)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in lists[g]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
        for g in s:
            lists[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))),
                  key=str)


def families(seed=0):
    """Families of edited copies, documents with a shared passage, chains."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=60)
    rows = []
    for _ in range(8):
        base = rng.choices(words, k=rng.randint(6, 300))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    for _ in range(25):
        own = rng.choices(words, k=rng.randint(2, 80))
        rows.append(own[:len(own) // 2] + passage + own[len(own) // 2:])
    chain = rng.choices(words, k=120)
    for k in range(12):
        rows.append(chain[k * 6:] + rng.choices(words, k=k * 6))
    rows += [rng.choices(words, k=rng.randint(1, 7)) for _ in range(20)]
    rows += [rows[0], rows[1], rows[30]]
    rng.shuffle(rows)
    return [(i * 3, " ".join(r)) for i, r in enumerate(rows)]


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(map(tuple, nj.shingle_classes(docs, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    rows = families(seed)
    assert run(spark, rows) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    """Chunks, buckets, index blocks and query turns of a few rows change nothing."""
    for name, value in (("CHUNK_POSTINGS", 300), ("BUCKET_POSTINGS", 200), ("INDEX_TEXTS", 3),
                        ("QUERY_TEXTS", 2)):
        monkeypatch.setattr(nj, name, value)
    rows = families(2)
    assert run(spark, rows) == brute(rows)


def test_numbers_do_not_follow_the_splits(spark, monkeypatch):
    """A text keeps its number when a later job cuts the scan of the sets in another way."""
    seen = {}

    def links(sets, percent):
        for n in ("1g", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", n)
            seen[n] = {bytes(r.key): r.k for r in sets.select("key", "k").collect()}
        return spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(nj, "_links", links)
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "1")
    try:
        run(spark, families(0))
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    assert len(set(seen["1g"].values())) == len(seen["1g"]) > 50
    assert seen["1g"] == seen["1k"]


def test_null_ids_pass_links_on(spark):
    """A(1) ~ N(null) ~ B(2), where A and B are not linked; copies of N; a pair without ids."""
    w = [f"v{i}" for i in range(100)]
    a, n, b = (w + ["x"] * 4, w[10:] + [f"y{i}" for i in range(10)], w[20:] + [f"y{i}" for i in range(20)])
    pair = [f"z{i}" for i in range(60)]
    rows = [(2, " ".join(b)), (1, " ".join(a)), (None, " ".join(n)), (None, " ".join(n)),
            (None, " ".join(pair)), (None, " ".join(pair + ["end"])), (9, "alone")]
    assert brute(rows[:2]) == [(1, 100, 1), (2, 96, 2)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert Counter(c for d, _, c in got if d is None) == {1: 2, None: 2}


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, nj.shingle_classes(odd_docs).collect()), key=str)
    want = brute(rows)
    # a text that only has null ids has no component
    assert got == want
    assert nj.shingle_classes(no_docs).count() == 0
    out = nj.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    keep = {c for d, _, c in want if c is not None and d == c}
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(keep)
    assert ids.count(None) == 2
    assert nj.one_of_each(no_docs).count() == 0


def test_one_of_each_decides_by_text(spark):
    """Rows that repeat an id: other texts stay, copies and near copies go."""
    t = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(5, t[0]), (5, t[1]), (5, t[1]), (5, ""), (5, None), (3, t[0] + " end"), (7, t[1] + " end"),
            (8, t[2]), (8, t[2] + " end"), (None, t[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, nj.one_of_each(docs).collect()), key=str)
    assert [r for r in got if r[0] == 8] in ([(8, t[2])], [(8, t[2] + " end")])
    got = [(d, x or "") for d, x in got if d != 8]
    assert got == sorted([(3, t[0] + " end"), (5, t[1]), (5, ""), (None, t[0])], key=str)


def test_search_finds_what_all_pairs_find():
    rng = np.random.default_rng(0)
    base = np.arange(0, 400, 2)
    sets = []
    for _ in range(120):
        keep = rng.random(len(base)) < rng.choice([0.5, 0.8, 0.95])
        extra = rng.choice(np.arange(1, 2001, 2), rng.integers(0, 40), replace=False)
        sets.append(np.sort(np.concatenate([base[keep], extra])))
    sets += [np.array([5]), np.array([7, 9]), np.arange(1000, 1100)]
    index = nj.Inverted(sets, 75)
    for q in sets:
        want = [j for j, s in enumerate(sets)
                if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(index.search(q)) == want
    assert index.search(np.array([-1, -2])) == []


@pytest.mark.parametrize("bits", [3, 8])
def test_a_bucket_sends_a_row_a_range(bits):
    """Rows of a bucket are bounded by the ranges, whatever texts it holds; sums stay."""
    rng = np.random.default_rng(4)
    keys = rng.integers(-2 ** 63, 2 ** 63, 5000)
    none = [None, None]
    tables = [pa.table({"bucket": pa.array([b, b]), "keys": [keys[:3000].tobytes(), keys[2000:].tobytes()],
                        "texts": [np.arange(3000, dtype="<u2").tobytes()] * 2,
                        "hashes": [np.arange(3000, dtype="<u4").tobytes()] * 2,
                        "key64": pa.array(none, pa.int64()), "shared": pa.array(none, pa.int64())})
              for b in (0, 1)]
    known = pa.table({"bucket": pa.array([-1, -1]), "key64": pa.array(keys[[7, 7]]), "shared": pa.array([4, 5])})
    sent = [nj._count_shared(bits)(t) for t in (*tables, known)]
    assert [t.num_rows for t in sent] == [2 ** bits, 2 ** bits, 1]
    got = Counter()
    for part in {r for t in sent for r in t.column("range").to_pylist()}:
        t = nj._add_shared(pa.concat_tables([x.filter(pc.equal(x["range"], part)) for x in sent]))
        got.update(dict(zip(*(t.column(c).to_pylist() for c in ("key64", "shared")), strict=True)))
    want = Counter()
    for a, b in zip(keys[:3000].tolist(), keys[2000:].tolist(), strict=True):
        if a != b:
            want.update({a: 2, b: 2})
    want[int(keys[7])] += 9
    assert got == want


def test_a_bucket_takes_little_memory():
    """Counting a bucket takes a few numbers a posting beside the table."""
    rng = np.random.default_rng(5)
    n, keys = 200_000, rng.integers(-2**63, 2**63 - 1, 1000)
    rows = 4
    place = [rng.integers(0, len(keys), n // rows).astype("<u2").tobytes() for _ in range(rows)]
    hashes = [rng.integers(0, 2**32, n // rows).astype("<u4").tobytes() for _ in range(rows)]
    t = pa.table({"bucket": pa.array([0] * rows, pa.int64()),
                  "keys": pa.array([keys.astype("<i8").tobytes()] * rows, pa.binary()),
                  "texts": pa.array(place, pa.binary()), "hashes": pa.array(hashes, pa.binary())})
    tracemalloc.start()
    try:
        nj._shared_of(t)
        assert tracemalloc.get_traced_memory()[1] < 40 * n
    finally:
        tracemalloc.stop()


def test_groups_give_back_memory(monkeypatch):
    """A worker that counted or searched a group does not keep its peak."""
    ended = []
    monkeypatch.setattr(memory, "give_back", lambda: ended.append(1))
    one = np.array([7], "<i8").tobytes()
    t = pa.table({"bucket": [0], "keys": [one], "texts": [b"\0\0"], "hashes": [b"\1\0\0\0"]})
    nj._count_shared(8)(t)
    nj._add_shared(pa.table({"keys": [one], "counts": [b"\1\0\0\0"]}))
    none = pa.array([], pa.list_(pa.int64()))
    nj._search_block(75)(pa.table({"k": [], "label": [], "query": [], "hashes": none}))
    assert len(ended) == 3


def test_the_prefix_keeps_the_overlap():
    """What step 2 asks of a text is met by every text that has a partner."""
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        a = rng.choice(10_000, n, replace=False)
        b = np.union1d(a[rng.random(n) < 0.9], rng.choice(10_000, int(rng.integers(0, 8)), replace=False))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 75 * len(np.union1d(a, b)):
            continue
        pa_, pb = (np.sort(x)[:len(x) - nj.needed(len(x), 75) + int(nj.kept_overlap(len(x)))] for x in (a, b))
        least = max(1, nj.needed(n, 75) // 4)
        assert len(np.intersect1d(pa_, pb)) >= least


def test_hashes_follow_words():
    texts = ["a b c d e f", "A b\tC  d\x0be\x0cf ", "a b c d f e", "ab c d e f", "É x y z w", "é x y z w",
             "a b", "a b c d e", "x" * 3000 + " y", "", " ", None, "\xa0a b c d e"]
    for s in texts:
        for t in texts:
            same = shingles(s) == shingles(t)
            assert np.array_equal(shingle_hashes(s and s.encode()), shingle_hashes(t and t.encode())) == same
    many = sorted({w for _, t in families(3) for w in t.split()} | {"".join(p) for p in zip("abcdef", "fedcba")})
    assert len(set(word_hashes(" ".join(many).encode()).tolist())) == len(many)
    anagrams = [f"{a}{b}{c}{d}" for a in "abcd" for b in "abcd" for c in "abcd" for d in "abcd"]
    assert len(set(word_hashes(" ".join(anagrams).encode()).tolist())) == 256
