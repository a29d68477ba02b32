"""Staged pipeline resume and incremental (streaming) pair counts."""

from dataclasses import replace

import pytest

from wordpair.operators.cooccur import cooccurrence
from wordpair.operators.train import TrainingConfig
from wordpair.operators.vocab import build_vocabulary
from wordpair.plans.pipeline import PipelineConfig, corpus_stages, open_run, run_pipeline
from wordpair.sources import stages
from wordpair.sources.corpus import document_tokens
from wordpair.sources.stages import StageStore
from wordpair.streaming import compact, incremental as inc, latest_pairs, start_incremental_pairs

from paths import SF0001


CFG = PipelineConfig(training=TrainingConfig(d=8, epochs=1, blocks=2), z_samples=20, pmi_samples=100)


def versions(spark, out, names=("vocab", "tokens", "pairs", "vectors", "d1_partition", "d2_norms")):
    store = StageStore(spark, out)
    return {n: store.current(n)["version"] for n in names}


def test_pipeline_runs_skips_and_rebuilds(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").limit(40)
    toks = document_tokens(docs)
    vocab = {r.word for r in build_vocabulary(toks, 5).collect()}
    w = sorted(v for v in vocab if v == v.lower())[:8]   # questions are asked in lower case
    q = spark.createDataFrame([(i, "r", w[i % 8], w[(i + 1) % 8], w[(i + 2) % 8], w[(i + 3) % 8]) for i in range(8)],
                              "qid long, relation string, a string, b string, c string, d string")
    ctx = spark.createDataFrame([(0, [1.0] + [0.0] * 7), (1, [0.0] * 7 + [1.0])], "t long, c array<double>")
    out = str(tmp_path / "run")
    res = run_pipeline(spark, toks, out, CFG, q, ctx)
    assert res["vocab"].count() == len(vocab) and res["losses"].count() == 1 and res["d3_singular"].count() == 8
    full = cooccurrence(toks, res["vocab"], 10)
    assert res["pairs"].select("w1", "w2", "x").exceptAll(full).count() == 0
    assert res["pairs"].count() == full.count()
    for name in ("d1_summary", "d2_summary", "d3_summary", "d4_summary", "d5_summary", "d8_summary"):
        assert res[name].count() == 1
    assert res["d5_by_relation"].first().total == 8 and res["d6_relations"].count() == 1
    assert res["d9_samples"].count() == 2 and res["d10_probs"].count() == 20
    assert res["model"].first().d == 8 and res["model"].schema["lr"].dataType.simpleString() == "double"

    before = versions(spark, out)
    run_pipeline(spark, toks, out, CFG, q, ctx)
    assert versions(spark, out) == before                          # all skipped
    # another window: pairs and all after them, not the vocabulary
    run_pipeline(spark, toks, out, replace(CFG, window=3), q, ctx)
    last = versions(spark, out)
    assert all(last[n] == before[n] for n in ("vocab", "tokens"))
    assert all(last[n] > before[n] for n in ("pairs", "vectors", "d1_partition", "d2_norms"))
    # other questions: the stages that ask them
    d5 = StageStore(spark, out).current("d5_predictions")["version"]
    res = run_pipeline(spark, toks, out, replace(CFG, window=3), q.where("qid < 5"), ctx)
    assert versions(spark, out) == last and res["d5_predictions"].count() == 5
    assert StageStore(spark, out).current("d5_predictions")["version"] > d5


@pytest.mark.parametrize("breaks", ["a", "b", "manifest"])
def test_a_forced_run_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch, breaks):
    """Killed while it stores the second of two tables, or before the manifest."""
    out = str(tmp_path)

    def build(k):
        return lambda: (spark.range(k).toDF("a"), spark.range(2 * k).toDF("b"))

    def go(k, force):
        run = open_run(spark, out, force)
        run.stage(("a", "b"), {"same": 1}, (), build(k))
        run.stage("c", {}, ("a",), lambda: run.tables["a"].union(run.tables["b"]))
        return [run.tables[n].count() for n in "abc"]

    assert go(3, False) == [3, 6, 9]
    write = stages.write_stage

    def killed(df, path, *mode):
        if f"/{breaks}/" in path or (breaks == "manifest" and "_manifests/a" in path):
            df.write.parquet(path + "/_half")
            raise RuntimeError("killed")
        return write(df, path, *mode)

    monkeypatch.setattr(stages, "write_stage", killed)
    with pytest.raises(RuntimeError, match="killed"):
        go(5, True)
    monkeypatch.setattr(stages, "write_stage", write)
    assert go(7, False) == [3, 6, 9]                 # what was published is still whole
    assert go(4, True) == [4, 8, 12]
    assert go(9, False) == [4, 8, 12]


def test_other_input_is_seen(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").limit(30)
    cfg = PipelineConfig(min_count=1, window=2)
    got = []
    for some in (docs.where("doc_id < 10"), docs, docs):
        run = open_run(spark, str(tmp_path))
        corpus_stages(run, document_tokens(spark.createDataFrame(some.collect(), some.schema)), cfg)
        got.append((run.tables["vocab"].count(), run.versions["pairs"]))
    assert got[0][0] < got[1][0] and got[0][1] < got[1][1] and got[1] == got[2]


def test_missing_analogies(spark, tmp_path, caplog):
    toks = document_tokens(spark.read.parquet(f"{SF0001}/documents.parquet").limit(5))
    with pytest.raises(FileNotFoundError):
        run_pipeline(spark, toks, str(tmp_path / "x"), CFG, need_analogies=True)
    res = run_pipeline(spark, toks, str(tmp_path / "y"), CFG)
    assert "d5_predictions" not in res and "are skipped" in caplog.text


def test_incremental_pairs_equal_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    vocab = build_vocabulary(document_tokens(docs), 5).checkpoint()
    src = tmp_path / "src"
    docs.where("doc_id % 2 = 0").write.parquet(str(src / "a"))
    q = start_incremental_pairs(spark, str(src / "*"), "doc_id long, text string", vocab,
                                str(tmp_path / "pairs"), str(tmp_path / "ck"), window=10)
    q.awaitTermination()
    compact(spark, str(tmp_path / "pairs"))
    docs.where("doc_id % 2 = 1").write.parquet(str(src / "b"))
    q = start_incremental_pairs(spark, str(src / "*"), "doc_id long, text string", vocab,
                                str(tmp_path / "pairs"), str(tmp_path / "ck"), window=10)
    q.awaitTermination()
    got = latest_pairs(spark, str(tmp_path / "pairs"))
    full = cooccurrence(document_tokens(docs), vocab, 10)
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
    folders = sorted(f.name for f in (tmp_path / "pairs").iterdir())
    assert folders == ["run=0-0", "run=1-1"]


def test_runs_are_merged_by_levels(spark, tmp_path):
    """30 batches, four a level: few runs are left, and their sum is that of all."""
    folder = str(tmp_path / "pairs")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for b in range(30):
            inc._write_run(spark.createDataFrame([(1, 2, 1), (1, b + 3, b + 1)], "w1 int, w2 int, x long"),
                           inc._run(folder, b, b))
            inc.merge_levels(spark, folder, fan=4)
            if b == 20:   # a merge that was broken off before it deleted what it had merged
                inc._write_run(spark.createDataFrame([(1, 2, 1)], "w1 int, w2 int, x long"), inc._run(folder, 5, 5))
        runs = inc._covering(inc._listed(spark, folder))
        assert runs == [(0, 15), (16, 19), (20, 23), (24, 27), (28, 28), (29, 29)]
        assert {(r.w1, r.w2): r.x for r in latest_pairs(spark, folder).collect()} == {
            (1, 2): 30, **{(1, b + 3): b + 1 for b in range(30)}}
        compact(spark, folder)
        assert inc._listed(spark, folder) == [(0, 29)]
        assert latest_pairs(spark, folder).count() == 31
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
