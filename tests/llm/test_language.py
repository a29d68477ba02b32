import itertools

import numpy as np
import pytest

from wordpair.llm import language as lg

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ne"], "bb": ["strü", "schä", "pf", "eng", "ung"],
             "cc": ["çon", "été", "ille", "eau", "oux"]}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(0)
    rows = [(text(rng, k, 60), k) for k in SYLLABLES for _ in range(20)] + [("junk", None), (None, "aa")]
    return lg.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))


def test_single_and_mixed(spark, model):
    rng = np.random.default_rng(1)
    rows = [(text(rng, k, 40), k) for k in SYLLABLES for _ in range(15)]
    got = lg.identify(spark.createDataFrame(rows, "text string, truth string"), model).collect()
    assert all(r.lang_pred == r.truth and r.lang_score > 0.9 and len(r.lang_mix) == 1 for r in got)
    both = [(text(rng, "aa", 120) + " " + text(rng, "cc", 60),), (text(rng, "bb", 90) + " " + text(rng, "aa", 90),)]
    a, b = (r.lang_mix for r in lg.identify(spark.createDataFrame(both, "text string"), model).collect())
    assert set(a) == {"aa", "cc"} and a["aa"] > a["cc"] > 0.15
    assert set(b) == {"aa", "bb"}


def test_em_reaches_the_best_proportion(model):
    """Two languages: the estimate is where the likelihood along the line peaks."""
    rng = np.random.default_rng(2)
    t = (text(rng, "aa", 80) + " " + text(rng, "bb", 40)).encode()
    mix = lg.Mixture(model).infer([t])[0]
    found, count = lg._counts(t)
    p, q = (np.exp(model[k][found].astype(float)) for k in ("aa", "bb"))
    grid = np.linspace(0.01, 0.99, 197)
    best = grid[np.argmax([(count * np.log(w * p + (1 - w) * q)).sum() for w in grid])]
    assert abs(mix["aa"] - best) < 0.03


@pytest.mark.parametrize("langs, grams, share, sim", [(10, 10 ** 6, .06, .3), (40, 3 * 10 ** 6, .08, .15)])
def test_long_text_of_similar_languages(langs, grams, share, sim):
    """A small second language is found where 8 steps are far from the maximum."""
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, 1 << lg.BITS)
    model = {}
    for i in range(langs):
        x = base + rng.normal(0, sim, 1 << lg.BITS)
        model[f"l{i:02d}"] = (x - np.log(np.exp(x).sum())).astype(np.float32)
    p = sum(w * np.exp(model[k].astype(float)) for k, w in (("l00", 1 - share), ("l01", share)))
    count = rng.multinomial(grams, p / p.sum())
    found = np.flatnonzero(count)
    mix = lg.Mixture(model)._block([(found, count[found])])[0]
    assert set(mix) == {"l00", "l01"} and mix["l00"] > 0.8


def test_slack_bounds_the_maximum(model):
    rng = np.random.default_rng(5)
    found, count = lg._counts((text(rng, "aa", 300) + " " + text(rng, "bb", 20)).encode())
    mixture = lg.Mixture(model)
    e = lg.Entries(np.zeros(len(found), int), count.astype(np.float32), mixture.logp[found])
    start = np.full((1, 3), 1 / 3, np.float32)
    best = e.em(start, 3000)[1]
    for steps in (1, 2, 4, 8, 16):
        pi, ll = e.em(start, steps)
        assert ll + e.slack(e.gain(pi)) >= best - 1e-3
    for need in (10.0, 1.0, 0.1):
        pi, ll, slack = e.settle(start, np.array([need]))
        assert slack <= max(need, 2 * lg.ROUNDING * count.sum()) and best - slack - 1e-2 <= ll <= best + 1e-2


def plain_em(logp, count, steps=4000):
    """Proportions and log-likelihood, double precision, nothing but the definition."""
    pi = np.full(logp.shape[1], 1 / logp.shape[1])
    p = np.exp(logp.astype(np.float64))
    for _ in range(steps):
        joint = p * pi
        joint /= joint.sum(axis=1, keepdims=True)
        pi = (joint * count[:, None]).sum(axis=0) / count.sum()
    return pi, float((count * np.log(p @ pi)).sum())


def test_identify_against_plain_em_over_all_sets_of_languages(spark, model):
    rng = np.random.default_rng(11)
    parts = [("aa", 40), ("bb", 40), ("cc", 40), ("aa", 3), ("cc", 1)]
    mixed = [[("aa", 200), ("bb", 150)], [("aa", 300), ("cc", 6)], [("bb", 60), ("cc", 60), ("aa", 60)],
             [("cc", 400), ("bb", 2)], [("aa", 25), ("bb", 25)]]
    texts = [" ".join(text(rng, k, n) for k, n in m) for m in [[p] for p in parts] + mixed]
    got = {r.text: r for r in lg.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    langs = sorted(model)
    logp = np.stack([model[k] for k in langs], axis=1)
    several = 0
    for t in texts:
        found, count = lg._counts(t.encode())
        value = {}
        for k in range(1, len(langs) + 1):
            for some in itertools.combinations(range(len(langs)), k):
                pi, ll = plain_em(logp[found][:, some], count)
                value[some] = (ll - k * lg.PENALTY * np.log(max(count.sum(), 2)), pi)
        best = max(value, key=lambda s: value[s][0])
        r = got[t]
        mine = tuple(langs.index(k) for k in sorted(r.lang_mix))
        assert value[mine][0] >= value[best][0] - lg.CLOSE
        share = dict(zip((langs[i] for i in mine), value[mine][1], strict=True))
        assert all(abs(share[k] - v) < 0.02 for k, v in r.lang_mix.items())
        assert r.lang_pred == max(sorted(share), key=share.get) and abs(r.lang_score - share[r.lang_pred]) < 0.02
        several += len(mine) > 1
    assert several >= 2


def test_characters_that_are_no_letters(spark, model):
    none = ["½ ² ① Ⅷ", "123 _ !", "…—", "٣"]
    some = ["é", "½a", "ª", "漢", "ʰ", "ǅ"]
    got = {r.text: r.lang_pred for r in lg.identify(
        spark.createDataFrame([(t,) for t in none + some], "text string"), model).collect()}
    assert all(got[t] == "und" for t in none) and all(got[t] != "und" for t in some)


def test_blocks_do_not_matter(model, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [text(rng, k, n).encode() for k in SYLLABLES for n in (1, 30, 2000)]
    a = lg.Mixture(model).infer(texts)
    monkeypatch.setattr(lg, "ENTRIES", 1)
    b = lg.Mixture(model).infer(texts)
    for x, y in zip(a, b, strict=True):
        assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-4 for k in x)


def test_odd_rows(odd_docs, no_docs, model):
    known = lg.fit(odd_docs)
    assert set(known) == {"en", "de", "fr"}
    rows = lg.identify(odd_docs, known).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r.lang_score <= 1
        assert (r.lang_pred == "und") == (not (r.text or "").strip())
    extra = [c for c in odd_docs.columns if c != "lang_pred"]
    assert lg.identify(odd_docs, model).columns == [*extra, "lang_pred", "lang_score", "lang_mix"]
    assert lg.identify(no_docs, model).count() == 0
    assert lg.fit(no_docs) == {}
    assert {r.lang_pred for r in lg.identify(odd_docs, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from wordpair.llm import queries
    out = queries.op10_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = out.where("held_out").join(docs, "doc_id").selectExpr(
        "avg(case when lang_pred = lang then 1.0 else 0.0 end) as a", "count(*) as n").first()
    assert row.n > 200 and row.a >= 0.97
