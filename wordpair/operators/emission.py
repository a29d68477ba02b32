"""Word emissions p(w | c) proportional to exp(<v_w, c>) from
discourse vectors c (each scaled to norm 4 / mean ||v_w|| first, not
renormalised)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordpair.operators.diagnostics import mean_norm
from wordpair.operators.scoring import GumbelMax, SoftmaxParts, one_sided


def _scaled_contexts(vectors: DataFrame, contexts: DataFrame, t_col: str, c_col: str) -> DataFrame:
    scale = 4.0 / mean_norm(vectors)
    return contexts.select(F.col(t_col).cast("bigint").alias("qid"),
                           F.transform(c_col, lambda x: x.cast("double") * F.lit(scale)).alias("c"))


def emission_probs(vectors: DataFrame, contexts: DataFrame, k: int = 10,
                   t_col: str = "t", c_col: str = "c") -> DataFrame:
    """``(t, rank, id, p)``: the k most probable words per context.

    The softmax normaliser is merged from per-task (max, sum exp(l - max))
    pairs -- the log-sum-exp merge -- and the global top-k from per-task
    top-k lists (at most k x tasks rows per context)."""
    q = _scaled_contexts(vectors, contexts, t_col, c_col)
    # k rows per context and task, stored: the product runs once for both uses
    parts = one_sided(vectors, q, lambda block: SoftmaxParts(block, k), SoftmaxParts.schema, "softmax")
    blocks = parts.select("qid", "vb", "m", "se").dropDuplicates(["qid", "vb"])
    norm = (blocks.groupBy("qid")
                  .agg(F.max("m").alias("M"),
                       F.collect_list(F.struct("m", "se")).alias("ms")))
    # Z = sum_b se_b * exp(m_b - M); lists hold one entry per task
    norm = norm.select("qid", "M", F.aggregate("ms", F.lit(0.0),
                       lambda acc, e: acc + e["se"] * F.exp(e["m"] - F.col("M"))).alias("Z"))
    w = Window.partitionBy("qid").orderBy(F.col("logit").desc(), F.col("id").asc())
    top = parts.select("qid", "id", "logit").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (top.join(norm, "qid")
               .select(F.col("qid").alias("t"), F.col("rank").cast("int").alias("rank"), "id",
                       (F.exp(F.col("logit") - F.col("M")) / F.col("Z")).alias("p")))


def sample_emissions(vectors: DataFrame, contexts: DataFrame, seed: int = 0,
                     t_col: str = "t", c_col: str = "c") -> DataFrame:
    """One seeded draw per context, ``(t, id)``.

    Gumbel-max: argmax_w <v_w, c> + G(seed, t, w) is an exact softmax draw;
    the noise is a hash of (seed, t, w), so the draw does not depend on how
    words are blocked, and per-block winners merge by a plain max."""
    q = _scaled_contexts(vectors, contexts, t_col, c_col)
    best = one_sided(vectors, q, lambda block: GumbelMax(block, seed), GumbelMax.schema, "draws")
    top = best.groupBy("qid").agg(F.max(F.struct(F.col("score"), (-F.col("id")).alias("neg"))).alias("b"))
    return top.select(F.col("qid").alias("t"), (-F.col("b.neg")).cast("int").alias("id"))
