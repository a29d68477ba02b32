"""Diagnostics of fitted vectors: D1/D8 partition function, D2 norm vs
frequency, D3 singular values (TSQR), D6 relation directions, histogram."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.functions.vec import dot, norm, safe_div, sqnorm, vsub
from wordpair.operators.fanin import FAN_IN, merge_tree
from wordpair.operators.sampling import uniform
from wordpair.operators.scoring import ExpSum, one_sided, to_matrix
from wordpair.session import materialize


# ------------------------------------------------------------ D1 / D8
def mean_norm(vectors: DataFrame) -> float:
    """A10: mean of ||v_w|| (a scalar: the scale of every direction)."""
    return float(vectors.agg(F.avg(norm("v"))).first()[0])


def random_directions(spark: SparkSession, n_samples: int, d: int, seed: int = 0) -> DataFrame:
    """``(s BIGINT, c ARRAY<DOUBLE>)``: standard normal vectors from hashes.

    Box-Muller on two uniforms from hashes of (seed, s, k, j): the values do
    not depend on partitioning and are generated inside the JVM.
    """
    def unif(k, j):
        return uniform(F.lit(seed), "s", k, F.lit(j))
    c = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                    lambda k: F.sqrt(F.lit(-2.0) * F.log(unif(k, 0)))
                    * F.cos(F.lit(2 * math.pi) * unif(k, 1)))
    return spark.range(n_samples).select(F.col("id").alias("s")).select("s", c.alias("c"))


def partition_function(vectors: DataFrame, directions: DataFrame | None = None,
                       n_samples: int = 1000, seed: int = 0, renormalize: bool = True,
                       id_col: str = "s", dir_col: str = "c") -> tuple[DataFrame, DataFrame]:
    """D1 (random or given directions) and D8 (``renormalize=False``: context
    vectors are only scaled, as along a path of unit vectors).

    Every direction is scaled to norm 4 / mean ||v_w||, then
    Z_c = sum_w exp(<v_w, c>).  Returns ``(detail, summary)``:
    detail ``(s, z, normalised)``, summary ``(n, mean_z, c_norm, std_ratio,
    frac_in_band)`` where std_ratio is the sample std of z / mean z.
    """
    spark = vectors.sparkSession
    mu = mean_norm(vectors)
    scale = 4.0 / mu
    if directions is None:
        d = int(vectors.agg(F.max(F.size("v"))).first()[0])
        directions = random_directions(spark, n_samples, d, seed)
        id_col, dir_col = "s", "c"
    c = F.col(dir_col)
    if renormalize:
        nc = norm(c)
        scaled = F.transform(c, lambda x: x.cast("double") / nc * F.lit(scale))
    else:
        scaled = F.transform(c, lambda x: x.cast("double") * F.lit(scale))
    q = directions.select(F.col(id_col).cast("bigint").alias("qid"), scaled.alias("c"))
    parts = one_sided(vectors, q, ExpSum, ExpSum.schema, "z-parts")
    # one row a direction, stored: the product runs once for detail, summary and bins
    z = materialize(parts.groupBy(F.col("qid").alias("s")).agg(F.sum("z").alias("z")), "z")
    mean_z = z.agg(F.avg("z")).scalar()
    detail = z.select("s", "z", (F.col("z") / mean_z).alias("normalised"))
    summary = detail.agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"),
                         F.stddev_samp("normalised").alias("std_ratio"),
                         F.avg(F.col("normalised").between(0.9, 1.1).cast("double"))
                         .alias("frac_in_band")).withColumn("c_norm", F.lit(scale))
    return detail, summary


def norm_deviation(contexts: DataFrame, c_col: str = "c") -> DataFrame:
    """``(n, max_dev)`` with max_dev = max |‖c‖ - 1| over a context
    table (the reference asserts < 1e-10 for its unit-sphere path)."""
    return contexts.agg(F.count(F.lit(1)).alias("n"),
                        F.max(F.abs(norm(c_col) - F.lit(1.0))).alias("max_dev"))


def extent(df: DataFrame, col: str) -> DataFrame:
    """``(lo, hi)`` of a column."""
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def histogram(df: DataFrame, col: str, bins: int = 60) -> DataFrame:
    """``(bin, lo, hi, count)`` over [min, max] in ``bins`` equal bins;
    the maximum falls in the last bin."""
    lo = df.agg(F.min(col)).scalar()
    hi = df.agg(F.max(col)).scalar()
    width = (hi - lo) / bins
    b = F.when(hi > lo, F.least(F.floor((F.col(col) - lo) / width) + 1, F.lit(bins))).otherwise(F.lit(1))
    h = df.select(b.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return h.select("bin", (lo + (F.col("bin") - 1) * width).alias("lo"),
                    (lo + F.col("bin") * width).alias("hi"), "count")


# ------------------------------------------------------------ D2
def norm_vs_frequency(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, sq_norm, log_freq)`` and ``(n, correlation)``."""
    total = vectors.agg(F.sum("count").cast("double")).scalar()
    detail = vectors.select("id", sqnorm("v").alias("sq_norm"),
                            F.log(F.col("count").cast("double") / total).alias("log_freq"))
    summary = detail.agg(F.count(F.lit(1)).alias("n"),
                         F.corr("sq_norm", "log_freq").alias("correlation"))
    return detail, summary


# ------------------------------------------------------------ D3 (TSQR)
def _qr_r(A: np.ndarray) -> np.ndarray:
    if A.shape[0] == 0:
        return A
    return np.linalg.qr(A, mode="r")


def _r_rows(R: np.ndarray) -> pa.Table:
    return pa.table({"g": pa.array([0], pa.int64()), "r": pa.array([R.ravel().tolist()]),
                     "rows": pa.array([R.shape[0]], pa.int32()),
                     "cols": pa.array([R.shape[1]], pa.int32())})


_R_SCHEMA = "g long, r array<double>, rows int, cols int"


def _partition_qr(it):
    """Per partition: fold row batches into one R factor (bounded d x d)."""
    R = None
    for batch in it:
        if batch.num_rows == 0:
            continue
        A = to_matrix(batch.column("v"))
        R = _qr_r(A if R is None else np.vstack([R, A]))
    if R is not None:
        yield (_r_rows(R).append_column("part", pa.array([TaskContext.get().partitionId()], pa.int64()))
               .to_batches()[0])


def _stack_qr(t: pa.Table) -> pa.Table:
    mats = [np.asarray(r, dtype=np.float64).reshape(nr, nc) for r, nr, nc in
            zip(t.column("r").to_pylist(), t.column("rows").to_pylist(), t.column("cols").to_pylist())]
    return _r_rows(_qr_r(np.vstack(mats)))


def _svd_rows(t: pa.Table) -> pa.Table:
    R = np.vstack([np.asarray(r, dtype=np.float64).reshape(nr, nc) for r, nr, nc in
                   zip(t.column("r").to_pylist(), t.column("rows").to_pylist(),
                       t.column("cols").to_pylist())])
    s = np.linalg.svd(R, compute_uv=False)
    return pa.table({"k": pa.array(np.arange(1, len(s) + 1), pa.int32()), "sigma": s})


def singular_values(vectors: DataFrame, fanout: int = 16) -> tuple[DataFrame, DataFrame]:
    """D3: singular values of V by tall-skinny QR.

    Each partition folds its rows into an R factor (d x d at most); R
    factors are merged ``fanout`` at a time by grouped QR until one is left,
    whose SVD gives the values (R has the singular values of V).  No step
    holds more than ``fanout`` d x d matrices.  Returns ``(values (k,
    sigma), summary (n_values, rms, min_nonzero, ratio, energy))``; energy
    = sum sigma^2 = sum ||v_w||^2.
    """
    parts = materialize(vectors.select("v").mapInArrow(_partition_qr, _R_SCHEMA + ", part long"), "qr")
    whole = merge_tree(parts, ["g"], _stack_qr, _R_SCHEMA, fanout)
    sv = whole.groupBy("g").applyInArrow(_svd_rows, "k int, sigma double")
    rms = sv.agg(F.sqrt(F.avg(F.col("sigma") * F.col("sigma")))).scalar()
    summary = sv.agg(F.count(F.lit(1)).alias("n_values"),
                     F.min(F.when(F.col("sigma") > rms * 1e-10, F.col("sigma"))).alias("min_nonzero"),
                     F.sum(F.col("sigma") * F.col("sigma")).alias("energy"))
    summary = summary.select("n_values", rms.alias("rms"), "min_nonzero",
                             (F.col("min_nonzero") / rms).alias("ratio"), "energy")
    return sv, summary


def power_sums(values: DataFrame) -> DataFrame:
    """``(n_values, p2, p4, p6)``: sums of sigma^2, sigma^4, sigma^6, which equal the
    traces of the powers of V^T V."""
    s2 = F.col("sigma") * F.col("sigma")
    return values.agg(F.count(F.lit(1)).alias("n_values"), F.sum(s2).alias("p2"),
                      F.sum(s2 * s2).alias("p4"), F.sum(s2 * s2 * s2).alias("p6"))


# ------------------------------------------------------------ D6
def relation_pairs(vectors: DataFrame, questions: DataFrame, lowercase: bool = True,
                   min_pairs: int = 5) -> DataFrame:
    """P9 + P10: ``(relation, a_id, b_id, n_pairs)`` for questions whose a and
    b are in the vocabulary, in relations with at least ``min_pairs`` such
    questions (repeats kept: a repeated pair weighs more)."""
    key = (lambda c: F.lower(F.col(c))) if lowercase else (lambda c: F.col(c))
    ids = vectors.select(F.col("word").alias("_w"), F.col("id"))
    q = questions.select("relation", key("a").alias("a"), key("b").alias("b"))
    q = (q.join(ids.withColumnRenamed("_w", "a").withColumnRenamed("id", "a_id"), "a")
          .join(ids.withColumnRenamed("_w", "b").withColumnRenamed("id", "b_id"), "b"))
    per = q.groupBy("relation", "a_id", "b_id").agg(F.count(F.lit(1)).alias("w"))
    sizes = per.groupBy("relation").agg(F.sum("w").alias("n_pairs")).where(F.col("n_pairs") >= min_pairs)
    return per.join(sizes, "relation")


def _partial_moments(batches):
    """(relation, w, diff) rows -> one weighted d x d moment per relation and task."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        D = to_matrix(b.column("diff"))
        w = b.column("w").to_numpy().astype(np.float64)
        rel = np.array(b.column("relation").to_pylist(), dtype=object)
        for r in set(rel.tolist()):
            at = rel == r
            M = (D[at] * w[at, None]).T @ D[at]
            total[r] = total[r] + M if r in total else M
    if total:
        yield pa.RecordBatch.from_pydict({
            "relation": pa.array(list(total)), "m": pa.array([M.ravel().tolist() for M in total.values()]),
            "d": pa.array([M.shape[0] for M in total.values()], pa.int32()),
            "part": pa.array([TaskContext.get().partitionId()] * len(total), pa.int64())})


def _add_moments(t: pa.Table) -> pa.Table:
    M = np.sum([np.asarray(m) for m in t.column("m").to_pylist()], axis=0)
    return pa.table({"relation": t.column("relation")[:1], "m": pa.array([M.tolist()]),
                     "d": t.column("d")[:1]})


def _top2_kernel(t: pa.Table) -> pa.Table:
    d = int(t.column("d")[0].as_py())
    M = np.asarray(t.column("m")[0].as_py()).reshape(d, d)
    vals, vecs = np.linalg.eigh(M)
    order = np.argsort(vals)[::-1]
    u1 = vecs[:, order[0]]
    n_unique = int(t.column("n_unique")[0].as_py())
    u2 = vecs[:, order[1]] if (d >= 2 and n_unique >= 2) else np.zeros(d)
    return pa.table({"relation": [t.column("relation")[0].as_py()],
                     "u1": pa.array([u1.tolist()]), "u2": pa.array([u2.tolist()])})


def relation_directions(vectors: DataFrame, questions: DataFrame, lowercase: bool = True,
                        min_pairs: int = 5, fan: int = FAN_IN) -> DataFrame:
    """Per relation, the top-2 left singular vectors u1, u2 of
    M = [v_a - v_b] and mean/std of cos(v_a - v_b, u_k) over its pairs.

    Repeated pairs are merged with a weight first; every task adds up its own
    d x d moments M M^T per relation, so a relation with a third of all pairs
    costs one row a task.  Those rows are added ``fan`` at a time, and ``eigh`` gives
    u1, u2.
    u1 is oriented so the mean cosine is non-negative; u2's sign is
    arbitrary (as in the reference).  ``(relation, n_pairs, mean1, std1,
    mean2, std2)``.
    """
    rp = relation_pairs(vectors, questions, lowercase, min_pairs)
    va = vectors.select(F.col("id").alias("a_id"), F.col("v").alias("va"))
    vb = vectors.select(F.col("id").alias("b_id"), F.col("v").alias("vb"))
    diffs = rp.join(va, "a_id").join(vb, "b_id").select(
        "relation", "a_id", "b_id", "w", "n_pairs", vsub("va", "vb").alias("diff"))
    diffs = materialize(diffs, "relation-diffs")
    moments = "relation string, m array<double>, d int"
    parts = materialize(diffs.select("relation", "w", "diff")
                        .mapInArrow(_partial_moments, moments + ", part long"), "moments")
    parts = merge_tree(parts, ["relation"], _add_moments, moments, fan)
    uniq = diffs.groupBy("relation").agg(F.count(F.lit(1)).alias("n_unique"))
    dirs = (parts.join(uniq, "relation").groupBy("relation")
            .applyInArrow(_top2_kernel, "relation string, u1 array<double>, u2 array<double>"))
    nd = norm("diff")
    cos = (diffs.join(dirs, "relation")
           .select("relation", "w", "n_pairs",
                   safe_div(dot("diff", "u1"), nd).alias("cos1"),
                   safe_div(dot("diff", "u2"), nd).alias("cos2")))
    # weighted moments over the original (repeated) questions
    wsum = F.sum("w")
    means = cos.groupBy("relation").agg((F.sum(F.col("w") * F.col("cos1")) / wsum).alias("mean1"),
                                        (F.sum(F.col("w") * F.col("cos2")) / wsum).alias("mean2"))

    def std(c, mean):
        # deviations from the mean, so that nearly equal cosines do not cancel
        var = F.sum(F.col("w") * (F.col(c) - F.col(mean)) * (F.col(c) - F.col(mean))) / (wsum - 1)
        return F.when(wsum > 1, F.sqrt(var)).otherwise(F.lit(float("nan")))
    agg = (cos.join(means, "relation").groupBy("relation")
           .agg(F.first("n_pairs").alias("n_pairs"), F.first("mean1").alias("mean1"),
                std("cos1", "mean1").alias("std1"), F.first("mean2").alias("mean2"),
                std("cos2", "mean2").alias("std2")))
    return agg.select("relation", F.col("n_pairs").cast("bigint").alias("n_pairs"),
                      F.abs("mean1").alias("mean1"), "std1", "mean2", "std2")
