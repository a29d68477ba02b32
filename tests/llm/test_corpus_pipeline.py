"""run() stage by stage against plain Python on a whole small table."""

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402
from wordpair.llm import queries, toxicity  # noqa: E402
from wordpair.llm.store import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def key(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, f in cp.STAGES:
        docs = out[name] = written(f(spark, docs, SF), name)
    return out


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]


def test_columns(stages):
    for name in ("toxicity", "exact_dedup", "ngram_join", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_toxicity(spark, stages):
    docs = stages["documents"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(queries.fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert sorted(key(r) for r in scored if r.toxic_score < 0.5) == sorted(map(key, stages["toxicity"].collect()))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    kept = {r.doc_id for r in stages["toxicity"].collect()}
    assert not any(truth.get(i) == 1 for i in kept)
    clean = [i for i, y in truth.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_exact_dedup(stages):
    least = {}
    for r in sorted(stages["toxicity"].collect(), key=lambda r: r.doc_id):
        least.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r)
    assert sorted(map(key, least.values())) == sorted(map(key, stages["exact_dedup"].collect()))


def test_ngram_join(stages):
    from tests.llm.test_ngram_join import brute
    rows = stages["exact_dedup"].collect()
    keep = {d for d, _, c in brute([(r.doc_id, r.text) for r in rows]) if d == c}
    assert sorted(key(r) for r in rows if r.doc_id in keep) == sorted(map(key, stages["ngram_join"].collect()))


def test_mixing(stages):
    from tests.llm.test_mixing import shares, words
    before = {r.doc_id: r for r in stages["ngram_join"].collect()}
    copies = Counter(map(key, stages["mixing"].collect()))
    sizes, taken, most = Counter(), Counter(), defaultdict(int)
    for r in before.values():
        n = words(r.text)
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    for k, n in copies.items():
        assert k == key(before[k[0]]) and n <= 3
        taken[k[3]] += n * words(k[1])
    for s, t in shares(sizes).items():
        assert abs(taken[s] - t) <= max(0.05 * t, most[s])


def test_packing(stages):
    import public_tokenizers
    from tests.llm.test_packing import check
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [1])
           for r in stages["mixing"].collect()]
    n = check(stages["packing"].collect(), ids, 4096)
    assert n <= 2 + sum(len(x) for _, x in ids) / 4096 * 1.02


def test_run_is_the_last_stage(spark, stages):
    got = Counter((r.doc_id, r.piece, r.length) for r in cp.run(spark, SF).collect())
    assert got == Counter((r.doc_id, r.piece, r.length) for r in stages["packing"].collect())


@pytest.fixture(scope="module")
def odd_folder(spark, odd_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10, 0, 1), (17, 1, 0), (21, 1, 0), (None, 1, 1), (999, 0, 1), (20, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_stage_on_odd_documents(spark, odd_docs, odd_folder):
    """Nulls, blanks, repeats, long texts, and columns with the stages' own names."""
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    values = {c: docs.select(f"`{c}`").first()[0] for c in extra}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, odd_folder), name)
        assert docs.columns == odd_docs.columns
        rows = docs.collect()
        assert all(r[c] == values[c] for r in rows for c in extra), name   # no value of the user's changes
        assert Counter(map(key, rows)).keys() <= Counter(map(key, before.collect())).keys()
    packed = cp.pack(spark, docs, odd_folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_run_on_odd_documents_and_on_none(spark, odd_folder, tmp_path):
    rows = cp.run(spark, odd_folder).collect()
    assert rows and all(r.length >= 1 and r.offset >= 0 for r in rows)
    empty = str(tmp_path)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{odd_folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert cp.run(spark, empty).count() == 0
