import re
from collections import Counter
from math import floor
from fractions import Fraction

import numpy as np
import pytest

from wordpair.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, longest=3):
    f, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        words[lang] += 0
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, n, " ".join(w[i:i + n])) for i in range(len(w) - n + 1))
    return f, words


def brute(rows, least=10, top=2000):
    f, words = brute_counts(rows)
    f = {k: a for k, a in f.items() if a >= least}
    out = []
    for (lang, n, phrase), a in f.items():
        if n == 1:
            continue
        w = phrase.split(" ")
        cuts = []
        for k in range(1, n):
            le, ri = f[lang, k, " ".join(w[:k])], f[lang, n - k, " ".join(w[k:])]
            cuts.append((floor(Fraction(10 ** 6 * a * a, le * ri)), k, le, ri))
        score, _, le, ri = min(cuts)
        if n == 2 and any(m == 3 and g == lang and f" {phrase} " in f" {p} " and 100 * b >= 50 * a
                          for (g, m, p), b in f.items() if m == 3):
            continue
        out.append((lang, phrase, a, le, ri, words[lang], score))
    ranked = []
    for lang in words:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def got(docs, top=2000, least=10, **kw):
    phrases, words = C.phrase_counts(docs, least=least, **kw)
    return sorted(map(tuple, C.collocations(phrases, words, top=top).collect()))


def pairs(docs):
    return [(r.text, r.lang) for r in docs.select("text", "lang").collect()]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)


def test_ranks(small):
    assert got(small) == brute(pairs(small))


def test_top_cuts_each_language(small):
    assert got(small, top=7) == brute(pairs(small), top=7)


def test_shared_fingerprints_are_counted_by_text(small):
    f, _ = brute_counts(pairs(small))
    phrases, _ = C.phrase_counts(small, primes=(101, 103, 65521), range_bytes=1 << 16)
    assert {(r.lang, r.n, r.phrase): r.a for r in phrases.collect()} == {k: a for k, a in f.items() if a >= 10}


def test_odd_rows(odd_docs, no_docs):
    for least in (1, 2, 3):
        assert got(odd_docs.where("doc_id is null or doc_id not in (21, 22)"), least=least) == brute(
            pairs(odd_docs.where("doc_id is null or doc_id not in (21, 22)")), least=least)
    assert got(odd_docs, least=3) == brute(pairs(odd_docs), least=3)
    assert got(no_docs) == []


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "BUFFER", 50)
    monkeypatch.setattr(C, "BLOCK", 32)
    monkeypatch.setattr(C, "LONG_WORD", 16)
    rnd = np.random.default_rng(5)
    words = ["a", "b", "cc", "a\0", "w" * 15, "W" * 16, "w" * 17, "w" * 90, "é", ".", "x\t", "\n", " "]
    rows = [(i, " ".join(rnd.choice(words, 60)), None) for i in range(40)] + [(None, None, "en"), (1, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f, words = brute_counts([(t, lang) for _, t, lang in rows])
    phrases, counted = C.phrase_counts(docs, least=2, range_bytes=64)
    assert {(r.lang, r.n, r.phrase): r.a for r in phrases.collect()} == {k: a for k, a in f.items() if a >= 2}
    assert {r.lang: r.n for r in counted.collect()} == {k: n for k, n in words.items() if n >= 2}


def test_no_recount_without_shared_fingerprints(spark, small, monkeypatch):
    """Sums of checks over many buffers still fit the words."""
    def never(*args):
        raise AssertionError("counted by text")

    monkeypatch.setattr(C, "_by_text", never)
    many = small
    for _ in range(3):
        many = many.unionAll(many)
    f, _ = brute_counts(pairs(small))
    phrases, _ = C.phrase_counts(many, range_bytes=1 << 18)
    assert {(r.lang, r.n, r.phrase): r.a for r in phrases.collect()} == {k: 8 * a for k, a in f.items() if 8 * a >= 10}


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)],
                                    "lang string, n int, phrase string, a long")
    words = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    row = C.collocations(phrases, words).first()
    assert row.score == 10 ** 6 * (big - 7) ** 2 // (big * (big - 1))


def test_entries_survive_packing():
    rnd = np.random.default_rng(1)
    fp = np.sort(rnd.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    cols = [fp, rnd.integers(1, 1 << 32, 1000).astype(np.uint64), rnd.integers(0, C.CHECK, 1000).astype(np.uint16),
            rnd.integers(0, 1 << 40, 1000).astype(np.uint64)]
    assert all((a == b).all() for a, b in zip(cols, C.unpack(C.pack(*cols), 1000), strict=True))
