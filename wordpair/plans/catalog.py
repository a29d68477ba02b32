"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (or tables Spark derives from them)
in full.  Float outputs are rounded so that an independent SQL engine can
reproduce them bit for bit; the matching SQL lives in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.operators import cooccur as co
from wordpair.operators import encode as en
from wordpair.operators import pmi as pm
from wordpair.operators.vocab import build_vocabulary, vocab_stats
from wordpair.session import materialize
from wordpair.sources.corpus import (Tokens, conversation_tokens, document_tokens,
                                     event_tokens, read_table)

MIN_COUNT = 5
TOP_WORDS = 1_000         # T2: a top-k vocabulary, the limit is the feature
WINDOW = 10
X_FLOOR = 10
EVENT_MIN_COUNT = 1
EVENT_WINDOW = 3

Query = Callable[[SparkSession, str], DataFrame]


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------- corpora
def doc_tokens(spark: SparkSession, sf: str) -> Tokens:
    return document_tokens(read_table(spark, sf, "documents"))


def conv_tokens(spark: SparkSession, sf: str) -> Tokens:
    return conversation_tokens(read_table(spark, sf, "conversations"))


def ev_tokens(spark: SparkSession, sf: str) -> Tokens:
    return event_tokens(read_table(spark, sf, "events"))


def doc_vocab(spark, sf):
    return build_vocabulary(doc_tokens(spark, sf), MIN_COUNT)


def doc_pairs(spark, sf, boundary="sequence", stored=True):
    """Pairs of the documents corpus, ``stored`` where they are read several
    times (PMI: marginals, total, main join)."""
    toks = doc_tokens(spark, sf)
    vocab = build_vocabulary(toks, MIN_COUNT)
    pairs = co.cooccurrence(toks, vocab, WINDOW, boundary)
    return (materialize(pairs, "pairs") if stored else pairs), vocab


# ---------------------------------------------------------------- queries
def q_vocab_documents(spark, sf):
    return doc_vocab(spark, sf)


def q_vocab_stats_documents(spark, sf):
    return vocab_stats(doc_vocab(spark, sf))


def q_tokenize_documents(spark, sf):
    toks = doc_tokens(spark, sf)
    return en.tokenize(toks, build_vocabulary(toks, MIN_COUNT))


def q_vocab_top_k_documents(spark, sf):
    """Only the TOP_WORDS most frequent words get an id."""
    return build_vocabulary(doc_tokens(spark, sf), MIN_COUNT, TOP_WORDS)


def q_cooccurrence_documents(spark, sf):
    return doc_pairs(spark, sf, stored=False)[0]


def q_cooccurrence_documents_blocks(spark, sf):
    """The same counts through the pure DataFrame block/halo plan."""
    toks = doc_tokens(spark, sf)
    vocab = build_vocabulary(toks, MIN_COUNT)
    return co.cooccurrence(toks, vocab, WINDOW, method="blocks", engine="sql")


def q_cooccurrence_stream(spark, sf):
    return doc_pairs(spark, sf, "stream", stored=False)[0]


def q_cooccurrence_conversations(spark, sf):
    toks = conv_tokens(spark, sf)
    return co.cooccurrence(toks, build_vocabulary(toks, MIN_COUNT), WINDOW)


def q_cooccurrence_events(spark, sf):
    toks = ev_tokens(spark, sf)
    vocab = build_vocabulary(toks, EVENT_MIN_COUNT)
    return co.cooccurrence(toks, vocab, EVENT_WINDOW)


def q_matrix_facts_documents(spark, sf):
    return co.matrix_facts(doc_pairs(spark, sf, stored=False)[0])


def q_pair_marginals_documents(spark, sf):
    return co.pair_marginals(doc_pairs(spark, sf, stored=False)[0])


def q_symmetric_degree_documents(spark, sf):
    """U1 checked through its per-row shape: entries and sum per row."""
    sym = co.symmetric(doc_pairs(spark, sf, stored=False)[0])
    return sym.groupBy("w").agg(F.count(F.lit(1)).alias("nnz"),
                                F.sum("x").cast("bigint").alias("row_sum"),
                                F.sum((F.col("w") == F.col("c")).cast("int")).cast("bigint").alias("diag"))


def q_pmi_documents(spark, sf):
    t = pm.pmi_table(doc_pairs(spark, sf)[0], X_FLOOR)
    return t.select("w1", "w2", "x", _r("pmi").alias("pmi"))


def q_top_pmi_documents(spark, sf):
    pairs, vocab = doc_pairs(spark, sf)
    t = pm.top_pmi(pairs, vocab, 20, X_FLOOR)
    return t.select("w1", "w2", "word1", "word2", "x", _r("pmi").alias("pmi"))


_CORPUS_QUERIES: dict[str, Query] = {
        "vocab_documents": q_vocab_documents,
        "vocab_stats_documents": q_vocab_stats_documents,
        "vocab_top_k_documents": q_vocab_top_k_documents,
        "tokenize_documents": q_tokenize_documents,
        "cooccurrence_documents": q_cooccurrence_documents,
        "cooccurrence_documents_blocks": q_cooccurrence_documents_blocks,
        "cooccurrence_stream": q_cooccurrence_stream,
        "cooccurrence_conversations": q_cooccurrence_conversations,
        "cooccurrence_events": q_cooccurrence_events,
        "matrix_facts_documents": q_matrix_facts_documents,
        "pair_marginals_documents": q_pair_marginals_documents,
        "symmetric_degree_documents": q_symmetric_degree_documents,
        "pmi_documents": q_pmi_documents,
        "top_pmi_documents": q_top_pmi_documents,
}


# ================================================================ vectors
# Fixture-derived inputs: B6 vectors, B7 pairs, B8 contexts, B9 questions.
import math as _math  # noqa: E402

from wordpair.operators import analogy as an  # noqa: E402
from wordpair.operators import diagnostics as dg  # noqa: E402
from wordpair.operators import emission as em  # noqa: E402
from wordpair.operators import model as md  # noqa: E402
from wordpair.plans import fixtures as fx  # noqa: E402
from wordpair.sources.analogies import parse_analogies  # noqa: E402

X_MAX = 100.0
C0 = _math.log(X_MAX)
LR = 0.05
EPS = 1e-8
TOP_K = 10
HIST_BINS = 60


def _long(df: DataFrame, arr: str, *more: str, digits: int = 6) -> DataFrame:
    """(id, array[, array...]) -> (id, k, value[, ...]) with 1-based k."""
    cols = [arr, *more]
    z = F.arrays_zip(*[F.col(c) for c in cols])
    e = df.select("id", F.posexplode(z).alias("k0", "e"))
    return e.select("id", (F.col("k0") + 1).cast("int").alias("k"),
                    *[F.round(F.col("e")[c], digits).alias(c) for c in cols])


def q_norm_vs_frequency(spark, sf):
    d, _ = dg.norm_vs_frequency(fx.vectors(spark, sf))
    return d.select("id", _r("sq_norm").alias("sq_norm"), _r("log_freq").alias("log_freq"))


def q_norm_vs_frequency_summary(spark, sf):
    _, s = dg.norm_vs_frequency(fx.vectors(spark, sf))
    return s.select("n", _r("correlation").alias("correlation"))


def q_sn_loss(spark, sf):
    s = md.sn_loss(fx.synthetic_pairs(spark, sf), fx.vectors(spark, sf), C0, X_MAX)
    return s.select(*[_r(c, 4).alias(c) for c in ("loss", "weight", "wmse", "grad_c")])


def q_sn_gradient(spark, sf):
    g = md.sn_gradient(fx.synthetic_pairs(spark, sf), fx.vectors(spark, sf), C0, X_MAX)
    return _long(g, "g", digits=5)


def q_adagrad_step(spark, sf):
    vec = fx.vectors(spark, sf)
    params = vec.select("id", "v", F.transform("v", lambda x: F.lit(0.0)).alias("gacc"))
    g = md.sn_gradient(fx.synthetic_pairs(spark, sf), vec, C0, X_MAX)
    step = md.adagrad_step(params, g, LR, EPS)
    # sqrt(G) = |g| after one step from zero; G itself (~1e8) is past 5-decimal precision
    step = step.select("id", "v", F.transform("gacc", lambda a: F.sqrt(a)).alias("g_rms"))
    return _long(step, "v", "g_rms", digits=5)


def q_pmi_scatter(spark, sf):
    d, _ = pm.pmi_scatter(fx.vectors(spark, sf), fx.synthetic_pairs(spark, sf), None, X_FLOOR)
    return d.select("w1", "w2", "x", _r("pmi_emp").alias("pmi_emp"), _r("pmi_pred").alias("pmi_pred"))


def q_pmi_scatter_summary(spark, sf):
    _, s = pm.pmi_scatter(fx.vectors(spark, sf), fx.synthetic_pairs(spark, sf), None, X_FLOOR)
    return s.select("n", *[_r(c).alias(c) for c in ("correlation", "slope", "intercept")])


def _pf(spark, sf, renormalize):
    return dg.partition_function(fx.vectors(spark, sf), fx.contexts(spark, sf),
                                 renormalize=renormalize, id_col="t", dir_col="c")


def q_partition_function_path(spark, sf):
    d, _ = _pf(spark, sf, False)
    return d.select("s", _r("z", 5).alias("z"), _r("normalised").alias("normalised"))


def q_partition_function_path_summary(spark, sf):
    _, s = _pf(spark, sf, False)
    return s.select("n", _r("mean_z", 5).alias("mean_z"), _r("c_norm").alias("c_norm"),
                    _r("std_ratio").alias("std_ratio"), _r("frac_in_band").alias("frac_in_band"))


def q_partition_function_directions(spark, sf):
    d, _ = _pf(spark, sf, True)
    return d.select("s", _r("z", 5).alias("z"), _r("normalised").alias("normalised"))


def q_partition_function_random(spark, sf):
    d, _ = dg.partition_function(fx.vectors(spark, sf), n_samples=1000, seed=0)
    return d.select("s", _r("z", 5).alias("z"), _r("normalised").alias("normalised"))


def q_z_histogram(spark, sf):
    d, _ = _pf(spark, sf, False)
    h = dg.histogram(d, "normalised", HIST_BINS)
    return h.select("bin", _r("lo").alias("lo"), _r("hi").alias("hi"), "count")


def q_singular_values(spark, sf):
    sv, _ = dg.singular_values(fx.vectors(spark, sf))
    return sv.select("k", _r("sigma").alias("sigma"))


def q_singular_energy(spark, sf):
    _, s = dg.singular_values(fx.vectors(spark, sf))
    return s.select(F.col("n_values").cast("bigint").alias("n_values"), _r("energy", 4).alias("energy"))


def q_singular_summary(spark, sf):
    _, s = dg.singular_values(fx.vectors(spark, sf))
    return s.select("n_values", *[_r(c).alias(c) for c in ("rms", "min_nonzero", "ratio")])


def q_analogy_predictions(spark, sf):
    p = an.analogy_predictions(fx.vectors(spark, sf), fx.analogy_questions(spark, sf))
    return p.select("qid", "pred", _r("score").alias("score"), "correct")


def q_analogy_by_relation(spark, sf):
    p = an.analogy_predictions(fx.vectors(spark, sf), fx.analogy_questions(spark, sf))
    return an.accuracy_by_relation(p).select("relation", "correct", "total",
                                             _r("accuracy").alias("accuracy"))


def q_analogy_summary(spark, sf):
    q = fx.analogy_questions(spark, sf)
    p = an.analogy_predictions(fx.vectors(spark, sf), q)
    return an.accuracy_summary(p, q).select(_r("overall").alias("overall"), "n_correct",
                                            "n_eligible", "n_total", "n_relations")


def q_analogy_parse(spark, sf):
    return parse_analogies(fx.analogy_lines(spark, sf))


def q_relation_pairs(spark, sf):
    rp = dg.relation_pairs(fx.vectors(spark, sf), fx.analogy_questions(spark, sf))
    return rp.select("relation", "n_pairs").distinct()


def q_relation_directions(spark, sf):
    r = dg.relation_directions(fx.vectors(spark, sf), fx.analogy_questions(spark, sf))
    return r.select("relation", "n_pairs", *[_r(c).alias(c) for c in ("mean1", "std1")],
                    _r(F.abs("mean2")).alias("abs_mean2"), _r("std2").alias("std2"))


def q_emission_probs(spark, sf):
    e = em.emission_probs(fx.vectors(spark, sf), fx.contexts(spark, sf), TOP_K)
    return e.select("t", "rank", "id", _r("p", 8).alias("p"))


def q_sample_emissions(spark, sf):
    return em.sample_emissions(fx.vectors(spark, sf), fx.contexts(spark, sf), seed=0)


def q_train_losses(spark, sf):
    """D7 on the B7 pairs over the B6 vocabulary (rows-only check)."""
    from wordpair.operators.train import losses_frame, train
    vec = fx.vectors(spark, sf)
    _, _, losses = train(fx.synthetic_pairs(spark, sf), vec, d=16, epochs=3, blocks=2, seed=0)
    return losses_frame(spark, losses)


def q_context_norm_deviation(spark, sf):
    d = dg.norm_deviation(fx.contexts(spark, sf))
    return d.select("n", _r("max_dev", 10).alias("max_dev"))


def q_pmi_extent(spark, sf):
    d, _ = pm.pmi_scatter(fx.vectors(spark, sf), fx.synthetic_pairs(spark, sf), None, X_FLOOR)
    e = dg.extent(d, "pmi_pred")
    return e.select(_r("lo").alias("lo"), _r("hi").alias("hi"))


def q_embedding_summary(spark, sf):
    return md.embedding_summary(fx.vectors(spark, sf), C0)


_VECTOR_QUERIES = {
    "norm_vs_frequency": q_norm_vs_frequency,
    "norm_vs_frequency_summary": q_norm_vs_frequency_summary,
    "sn_loss": q_sn_loss,
    "sn_gradient": q_sn_gradient,
    "adagrad_step": q_adagrad_step,
    "pmi_scatter": q_pmi_scatter,
    "pmi_scatter_summary": q_pmi_scatter_summary,
    "partition_function_path": q_partition_function_path,
    "partition_function_path_summary": q_partition_function_path_summary,
    "partition_function_directions": q_partition_function_directions,
    "partition_function_random": q_partition_function_random,
    "z_histogram": q_z_histogram,
    "singular_values": q_singular_values,
    "singular_energy": q_singular_energy,
    "singular_summary": q_singular_summary,
    "analogy_predictions": q_analogy_predictions,
    "analogy_by_relation": q_analogy_by_relation,
    "analogy_summary": q_analogy_summary,
    "analogy_parse": q_analogy_parse,
    "relation_pairs": q_relation_pairs,
    "relation_directions": q_relation_directions,
    "emission_probs": q_emission_probs,
    "sample_emissions": q_sample_emissions,
    "embedding_summary": q_embedding_summary,
    "context_norm_deviation": q_context_norm_deviation,
    "pmi_extent": q_pmi_extent,
    "train_losses": q_train_losses,
}



# ------------------------------------------- real counts, lookups, reports
def _real(spark, sf):
    pairs, vocab = doc_pairs(spark, sf)
    return pairs, fx.document_vectors(spark, sf, vocab)


def q_sn_loss_documents(spark, sf):
    """A7 on the real document pairs with a vector for every document word."""
    pairs, vec = _real(spark, sf)
    s = md.sn_loss(pairs, vec, C0, X_MAX)
    return s.select(_r("weight", 4).alias("weight"), _r("wmse", 6).alias("wmse"),
                    (F.col("grad_c") / F.col("weight")).alias("g")).select(
                        "weight", "wmse", _r("g", 6).alias("grad_c_mean"))


def q_pmi_scatter_documents(spark, sf):
    """D4 on the real document pairs (x >= X_FLOOR, no sampling)."""
    pairs, vec = _real(spark, sf)
    d, _ = pm.pmi_scatter(vec, pairs, None, X_FLOOR, last=True)
    return d.select("w1", "w2", "x", _r("pmi_emp").alias("pmi_emp"), _r("pmi_pred").alias("pmi_pred"))


def q_norm_vs_frequency_documents(spark, sf):
    """D2 on the real document vocabulary."""
    d, _ = dg.norm_vs_frequency(fx.document_vectors(spark, sf, doc_vocab(spark, sf)))
    return d.select("id", _r("sq_norm").alias("sq_norm"), _r("log_freq").alias("log_freq"))


def q_word_lookup(spark, sf):
    """Ids of the questions' words, 0 where a word is in no vocabulary."""
    w = fx.analogy_questions(spark, sf).select("qid", F.explode(F.array("a", "b", "c", "d")).alias("word"))
    return en.word_ids(w, fx.vectors(spark, sf), lowercase=True).select("qid", "word", "id")


def q_vector_lookup(spark, sf):
    """Squared norms of the vectors of the questions' b words (null if unknown)."""
    w = fx.analogy_questions(spark, sf).select("qid", F.col("b").alias("word"))
    from wordpair.functions.vec import sqnorm
    out = md.vector_lookup(w, fx.vectors(spark, sf).select("word", "v"))
    return out.select("qid", "word", F.round(F.when(F.col("v").isNotNull(), sqnorm("v")), 6).alias("sq_norm"))


def q_upper_triangle_documents(spark, sf):
    """P5: the stored pairs come back from their symmetric view."""
    return co.upper_triangle(co.symmetric(doc_pairs(spark, sf, stored=False)[0])) \
        .select("w1", "w2", F.col("x"))


def q_merged_pairs_documents(spark, sf):
    """Pair counts of even and odd documents, added up."""
    docs = read_table(spark, sf, "documents")
    vocab = doc_vocab(spark, sf)
    halves = [co.cooccurrence(document_tokens(docs.where(F.pmod(F.col("doc_id"), F.lit(2)) == k)), vocab, WINDOW,
                              packed=True) for k in (0, 1)]
    return co.merge_counts(*halves)


def q_gamma(spark, sf):
    """F12 beside the fitted intercept of the document pairs' PMI scatter."""
    from wordpair.operators.pmi import gamma
    pairs, vec = _real(spark, sf)
    _, s = pm.pmi_scatter(vec, pairs, None, X_FLOOR, last=True)
    return s.select("n", F.round(F.lit(gamma(WINDOW)), 6).alias("gamma"), _r("intercept").alias("intercept"))


def q_analogy_topk(spark, sf):
    t = an.analogy_topk(fx.vectors(spark, sf), fx.analogy_questions(spark, sf), 3)
    return t.select("qid", "rank", "id", _r("score").alias("score"))


def q_analogy_report(spark, sf):
    """The by-relation report in order."""
    p = an.analogy_predictions(fx.vectors(spark, sf), fx.analogy_questions(spark, sf))
    r = an.accuracy_report(an.accuracy_by_relation(p))
    return r.select("relation", "correct", "total", _r("accuracy").alias("accuracy"))


def q_singular_power_sums(spark, sf):
    """D3 checked through the traces of the powers of V^T V."""
    sv, _ = dg.singular_values(fx.vectors(spark, sf))
    return dg.power_sums(sv).select("n_values", _r("p2", 3).alias("p2"),
                                    *[F.round(F.log(F.col(c)), 8).alias(f"log_{c}") for c in ("p4", "p6")])


def q_train_minibatch_losses(spark, sf):
    """D7 as mini-batches of full gradients: two steps over the pairs of B7."""
    from wordpair.operators.train import train_minibatch
    vec = fx.vectors(spark, sf)
    params = vec.select("id", F.transform("v", lambda x: x * F.lit(0.125)).alias("v"),
                        F.transform("v", lambda x: F.lit(0.0)).alias("gacc"))
    _, _, steps = train_minibatch(fx.synthetic_pairs(spark, sf), params, C0, n_batches=2, lr=LR, eps=EPS,
                                  x_max=X_MAX, batch=lambda a, b: (a + b) % 2)
    rows = [(e, k, round(w, 5), round(c, 6)) for e, k, w, c in steps]
    return spark.createDataFrame(rows, "epoch int, batch int, wmse double, c double")


def q_relation_first_direction(spark, sf):
    """D6 without the second direction, whose sign and basis are arbitrary."""
    r = dg.relation_directions(fx.vectors(spark, sf), fx.analogy_questions(spark, sf))
    return r.select("relation", "n_pairs", _r("mean1", 5).alias("mean1"), _r("std1", 5).alias("std1"))


# ------------------------------------------- streams, stages, samples, searches
PMI_SAMPLE = 5_000        # T4: the sample is the feature
FIT_DIMS = 8


def q_tokenize_conversations(spark, sf):
    """D0b over sequences of several rows."""
    toks = conv_tokens(spark, sf)
    return en.tokenize(toks, build_vocabulary(toks, MIN_COUNT))


def q_cooccurrence_files(spark, sf):
    """The documents as raw text files of unequal size, read back as one stream."""
    from wordpair.session import scratch_folder
    from wordpair.sources.corpus import read_corpus, write_corpus
    folder = scratch_folder(spark, "corpus")
    write_corpus(read_table(spark, sf, "documents"), folder,
                 F.format_string("%02d", F.length(F.bin("doc_id"))))
    toks = read_corpus(spark, f"{folder}/part=*")
    return co.cooccurrence(toks, build_vocabulary(toks, MIN_COUNT), WINDOW, "stream")


def q_stage_pairs_documents(spark, sf):
    """The pairs of a run that finds every stage published by the run before."""
    from wordpair.plans.pipeline import PipelineConfig, corpus_stages, open_run
    from wordpair.session import scratch_folder
    out, cfg = scratch_folder(spark, "stages"), PipelineConfig(min_count=MIN_COUNT, window=WINDOW)
    versions = []
    for _ in range(2):
        run = open_run(spark, out)
        corpus_stages(run, doc_tokens(spark, sf), cfg)
        versions.append(run.versions)
    if versions[0] != versions[1]:
        raise RuntimeError("a published stage was built again")
    return run.tables["pairs"].select("w1", "w2", "x", F.col("window").cast("int").alias("window"))


def q_pmi_sample_documents(spark, sf):
    """T4: a seeded sample of the document pairs with their PMI."""
    t = pm.sample_pairs(pm.pmi_table(doc_pairs(spark, sf)[0], X_FLOOR), PMI_SAMPLE, seed=1)
    return t.select("w1", "w2", "x", _r("pmi").alias("pmi"))


def q_analogy_topk_pruned(spark, sf):
    """T3 by the search that skips cells."""
    from wordpair.operators.nearest import pruned_analogies
    t, _ = pruned_analogies(fx.vectors(spark, sf), fx.analogy_questions(spark, sf), 3)
    return t.select("qid", "rank", "id", _r("score").alias("score"))


def q_fit_documents(spark, sf):
    """Two mini-batch steps on the real document pairs, and D2 and D4 of the vectors
    they give: one row."""
    from wordpair.operators.train import train_minibatch
    pairs, vec = _real(spark, sf)
    vec = vec.withColumn("v", F.slice("v", 1, FIT_DIMS))
    params = vec.select("id", "v", F.transform("v", lambda x: F.lit(0.0)).alias("gacc"))
    params, c, steps = train_minibatch(pairs, params, C0, n_batches=2, lr=LR, eps=EPS, x_max=X_MAX,
                                       batch=lambda a, b: (a + b) % 2)
    fitted = vec.select("id", "word", "count").join(params.select("id", "v"), "id")
    _, d2 = dg.norm_vs_frequency(fitted)
    _, d4 = pm.pmi_scatter(fitted, pairs, None, X_FLOOR, last=True)
    d2 = d2.select(_r("correlation", 5).alias("d2_correlation"))
    d4 = d4.select(F.col("n").alias("d4_n"), *[_r(k, 4).alias(f"d4_{k}") for k in ("correlation", "slope", "intercept")])
    return d2.join(d4).select(F.lit(round(steps[0][2], 5)).alias("wmse0"), F.lit(round(steps[1][2], 5)).alias("wmse1"),
                              F.lit(round(c, 6)).alias("c"), "*")


def q_relation_second_direction(spark, sf):
    """D6's second direction, up to its sign."""
    r = dg.relation_directions(fx.vectors(spark, sf), fx.analogy_questions(spark, sf))
    return r.select("relation", F.round(F.abs("mean2"), 4).alias("mean2"), _r("std2", 4).alias("std2"))


_MORE_QUERIES = {
    "relation_second_direction": q_relation_second_direction,
    "relation_first_direction": q_relation_first_direction,
    "sn_loss_documents": q_sn_loss_documents,
    "pmi_scatter_documents": q_pmi_scatter_documents,
    "norm_vs_frequency_documents": q_norm_vs_frequency_documents,
    "word_lookup": q_word_lookup,
    "vector_lookup": q_vector_lookup,
    "upper_triangle_documents": q_upper_triangle_documents,
    "merged_pairs_documents": q_merged_pairs_documents,
    "pmi_intercept_documents": q_gamma,
    "analogy_topk": q_analogy_topk,
    "analogy_report": q_analogy_report,
    "singular_power_sums": q_singular_power_sums,
    "train_minibatch_losses": q_train_minibatch_losses,
    "tokenize_conversations": q_tokenize_conversations,
    "cooccurrence_files": q_cooccurrence_files,
    "stage_pairs_documents": q_stage_pairs_documents,
    "pmi_sample_documents": q_pmi_sample_documents,
    "analogy_topk_pruned": q_analogy_topk_pruned,
    "fit_documents": q_fit_documents,
}


def registry() -> dict[str, Query]:
    return {**_CORPUS_QUERIES, **_VECTOR_QUERIES, **_MORE_QUERIES}
