"""The staged pipeline.

corpus -> vocab + tokens -> pairs (+ window) -> vectors + model + losses
       -> diagnostics (D1-D4, D6) -> analogies (D5) -> path results (D8-D10)

Each stage publishes its parquet tables together as a version (``sources.stages``).
A stage is skipped when its current version has the settings asked for, was given
the same input and was built on the current versions of the stages before it;
``force`` rebuilds all.  A run that breaks off, forced or not, leaves complete
versions only, and the next one builds what does not fit together.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.operators import analogy as an
from wordpair.operators import diagnostics as dg
from wordpair.operators import emission as em
from wordpair.operators import pmi as pm
from wordpair.operators.cooccur import sorted_stream_pairs
from wordpair.operators.encode import compact_positions, tokenize
from wordpair.operators.pmi import gamma  # noqa: F401  (F12, part of the pipeline's surface)
from wordpair.operators.train import TrainingConfig, losses_frame, train
from wordpair.operators.vocab import build_vocabulary
from wordpair.session import ensure_checkpoint_dir
from wordpair.sources.corpus import Tokens
from wordpair.sources.stages import StageStore, fingerprint

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class PipelineConfig:
    min_count: int = 5
    max_size: int | None = None
    window: int = 10
    boundary: str = "sequence"
    training: TrainingConfig = TrainingConfig()
    z_samples: int = 1000
    pmi_samples: int | None = None
    x_floor: float = 10
    seed: int = 0
    emission_k: int = 10


class _Run:
    """The stage tables of one output folder."""

    def __init__(self, spark: SparkSession, out: str, force: bool):
        self.store, self.force = StageStore(spark, out), force
        self.versions: dict[str, int] = {}
        self.tables: dict[str, DataFrame] = {}

    def stage(self, names: str | tuple[str, ...], settings: dict, after: tuple[str, ...],
              build: Callable[[], DataFrame | tuple[DataFrame, ...]], given: str = "") -> None:
        """Tables that one computation gives; ``given`` stands for input from outside."""
        names = (names,) if isinstance(names, str) else names
        facts = {"settings": settings, "after": {a: self.versions[a] for a in after}, "given": given}
        found = None if self.force else self.store.current(names[0])
        if not found or any(found[k] != v for k, v in facts.items()) or set(found["tables"]) != set(names):
            built = build()
            built = built if isinstance(built, tuple) else (built,)
            found = self.store.publish(names[0], dict(zip(names, built, strict=True)), **facts)
        self.versions |= dict.fromkeys(names, found["version"])
        self.tables |= self.store.load(found)


def corpus_stages(run: _Run, tokens: Tokens, cfg: PipelineConfig) -> dict:
    """Vocabulary, encoded tokens and pairs; returns the settings they depend on."""
    t, corpus = run.tables, fingerprint(tokens.df)
    vocab_set = {"min_count": cfg.min_count, "max_size": cfg.max_size}
    run.stage("vocab", vocab_set, (), lambda: build_vocabulary(tokens, cfg.min_count, cfg.max_size), corpus)
    vocab = t["vocab"]

    # one stream has its own positions; sequences are numbered from 1
    def encoded() -> DataFrame:
        if cfg.boundary == "stream":
            return compact_positions(tokens, vocab, "stream").select("seq_id", F.col("gp").alias("pos"), "id")
        return tokenize(tokens, vocab)
    run.stage("tokens", vocab_set | {"boundary": cfg.boundary}, ("vocab",), encoded, corpus)

    pair_set = vocab_set | {"window": cfg.window, "boundary": cfg.boundary}
    run.stage("pairs", pair_set, ("tokens",),
              lambda: sorted_stream_pairs(t["tokens"], ["seq_id", "pos"], cfg.window, cfg.boundary)
              .withColumn("window", F.lit(cfg.window)))
    return pair_set


def open_run(spark: SparkSession, out: str, force: bool = False) -> _Run:
    return _Run(spark, out, force)


def run_pipeline(spark: SparkSession, tokens: Tokens, out: str, cfg: PipelineConfig = PipelineConfig(),
                 analogies: DataFrame | None = None, contexts: DataFrame | None = None,
                 force: bool = False, need_analogies: bool = False) -> dict[str, DataFrame]:
    """Run (or resume) every stage; returns the stage tables by name.

    ``analogies`` (qid, relation, a, b, c, d) gives D5 and D6.  Without them D6 is
    skipped with a warning, and D5 too unless ``need_analogies``, which makes it
    an error.  ``contexts`` (t, c) gives D8-D10.
    """
    ensure_checkpoint_dir(spark)
    if analogies is None and need_analogies:
        raise FileNotFoundError("no analogy questions given")
    run = _Run(spark, out, force)
    t = run.tables
    asked = "" if analogies is None else fingerprint(analogies)
    path = "" if contexts is None else fingerprint(contexts)
    pair_set = corpus_stages(run, tokens, cfg)
    vocab = t["vocab"]
    pairs = t["pairs"].select("w1", "w2", "x")

    fit = cfg.training

    def fitted() -> tuple[DataFrame, ...]:
        vecs, C, losses = train(pairs, vocab, fit, resume_dir=f"{run.store.out}/_fit")
        row = {"c": float(C), **asdict(fit)}
        types = {"float": "double", "int": "long", "bool": "boolean"}
        ddl = ", ".join(f"{k} {types.get(type(v).__name__, 'long')}" for k, v in row.items())
        return vecs, losses_frame(spark, losses), spark.createDataFrame([tuple(row.values())], ddl)
    run.stage(("vectors", "losses", "model"), pair_set | {"training": asdict(fit)}, ("vocab", "pairs"), fitted)
    vec = t["vectors"]
    made = pair_set | {"training": asdict(fit), "seed": cfg.seed}

    run.stage(("d1_partition", "d1_summary"), made | {"n": cfg.z_samples}, ("vectors",),
              lambda: dg.partition_function(vec, n_samples=cfg.z_samples, seed=cfg.seed))
    run.stage(("d2_norms", "d2_summary"), made, ("vectors",), lambda: dg.norm_vs_frequency(vec))
    run.stage(("d3_singular", "d3_summary"), made, ("vectors",), lambda: dg.singular_values(vec))
    run.stage(("d4_pmi", "d4_summary"), made | {"n": cfg.pmi_samples, "floor": cfg.x_floor}, ("vectors", "pairs"),
              lambda: pm.pmi_scatter(vec, pairs, cfg.pmi_samples, cfg.x_floor, cfg.seed + 1))
    if analogies is None:
        log.warning("no analogy questions: analogy accuracy (D5) and relation directions (D6) are skipped")
    else:
        run.stage("d5_predictions", made, ("vectors",), lambda: an.analogy_predictions(vec, analogies), asked)
        pred = t["d5_predictions"]
        run.stage("d5_by_relation", made, ("d5_predictions",),
                  lambda: an.accuracy_report(an.accuracy_by_relation(pred)))
        run.stage("d5_summary", made, ("d5_predictions",), lambda: an.accuracy_summary(pred, analogies), asked)
        run.stage("d6_relations", made, ("vectors",), lambda: dg.relation_directions(vec, analogies), asked)
    if contexts is not None:
        run.stage(("d8_path", "d8_summary"), made, ("vectors",),
                  lambda: dg.partition_function(vec, contexts, renormalize=False, id_col="t", dir_col="c"),
                  path)
        run.stage("d9_samples", made, ("vectors",), lambda: em.sample_emissions(vec, contexts, cfg.seed), path)
        run.stage("d10_probs", made | {"k": cfg.emission_k}, ("vectors",),
                  lambda: em.emission_probs(vec, contexts, cfg.emission_k), path)
    return t
