"""Selection by digits, bounded fan-in, sparse copies of vectors."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordpair.operators import pair_blocks, sampling
from wordpair.operators.diagnostics import singular_values
from wordpair.operators.fanin import merge_tree
from wordpair.operators.pmi import sample_pairs


def h(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("ordered", [1 << 16, 1])
def test_sample_is_the_n_least_hashes(spark, monkeypatch, ordered):
    monkeypatch.setattr(sampling, "ORDERED_ROWS", ordered)
    df = spark.range(3000).select((F.col("id") % 50).cast("int").alias("w1"), F.col("id").cast("int").alias("w2"))
    want = sorted((h(7, r.w1, r.w2), r.w1, r.w2) for r in df.collect())
    for n in (0, 1, 2, 700, 2999, 3000, 5000):
        got = sorted((h(7, r.w1, r.w2), r.w1, r.w2) for r in sample_pairs(df.repartition(5), n, 7).collect())
        assert got == want[:n], n
    assert sample_pairs(df, None).count() == 3000


def test_sample_of_equal_hashes(spark):
    df = spark.range(100).select(F.lit(5).cast("long").alias("h"), "id")
    assert sorted(r.id for r in sampling.least_rows(df, "h", 30, ["id"]).collect()) == list(range(30))


def test_uniform_numbers(spark):
    got = spark.range(2000).select(sampling.uniform(F.lit(1), "id").alias("u")).toPandas()["u"]
    assert 0 < got.min() and got.max() < 1 and abs(got.mean() - 0.5) < 0.03
    assert got[3] == (h(1, 3) + 0.5) / 2 ** 52


def test_fan_in_is_bounded(spark):
    """200 tasks leave a row a key each: no group holds more than ``fan`` of them."""
    parts = spark.range(400).select(F.concat(F.lit("k"), F.col("id") % 2).alias("k"), F.col("id").alias("n"),
                                    F.floor(F.col("id") / 2).cast("long").alias("part"))

    def add(t: pa.Table) -> pa.Table:
        assert t.num_rows <= 5
        return pa.table({"k": t.column("k")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    got = merge_tree(parts, ["k"], add, "k string, n long", fan=5).collect()
    assert {r.k: r.n for r in got} == {"k0": sum(range(0, 400, 2)), "k1": sum(range(1, 400, 2))}
    assert merge_tree(parts.limit(0), ["k"], add, "k string, n long").count() == 0


def test_singular_values_of_many_partitions(spark):
    rng = np.random.default_rng(0)
    V = rng.standard_normal((90, 4))
    df = spark.createDataFrame([(v.tolist(),) for v in V], "v array<double>").repartition(40)
    got = [r.sigma for r in singular_values(df, fanout=3)[0].orderBy("k").collect()]
    assert np.allclose(got, np.linalg.svd(V, compute_uv=False))


def test_vectors_go_only_where_they_have_pairs(spark):
    """Rows of vectors in the cogroup are the distinct (word, block of a partner)."""
    pairs = spark.createDataFrame([(1, 2, 5), (1, 10, 5), (3, 4, 5), (1, 6, 5)], "w1 int, w2 int, x long")
    vec = spark.createDataFrame([(i, [1.0]) for i in range(1, 13)], "id int, v array<double>")

    def count(vt: pa.Table, xt: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([vt.num_rows], pa.int64())})

    got = pair_blocks.with_vectors(pairs, vec, count, "n long", blocks=4).agg(F.sum("n")).first()[0]
    ends = {(a, b % 4) for a, b in [(1, 2), (2, 1), (1, 10), (10, 1), (3, 4), (4, 3), (1, 6), (6, 1)]}
    assert got == len(ends)
