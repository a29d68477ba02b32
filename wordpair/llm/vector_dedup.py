"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured random product codes: after a random rotation
the dimensions fall into ``blocks`` parts, each with ``code`` random unit
directions, and a filter is one direction of each part (``code ** blocks`` in
all).  A vector passes every filter whose inner product with it is within
``margin`` of the largest one, its cap; list decoding finds them part by part
without going through all filters.  Vectors that share a filter are compared
exactly (cosine in double precision).

* Equal vectors are one representative with a multiplicity.
* A pair is compared in its first common filter only, so links are counted
  without a table of pairs: tasks send link counts and a spanning forest.
* The number of directions follows the number of vectors (``code_for``), so that a
  filter holds a few vectors at any size.
* Filters are found and counted by narrow rows of (vector, filter); vectors, and the
  lists of their shared filters, are attached only to filters with two or more.
* Filters are hashed into groups of about ``GROUP_ROWS`` rows; a filter with more
  than ``BLOCK`` vectors is split into pairs of blocks.

The directions do not depend on the vectors' values, so there is nothing to fit.
Measured recall on random pairs at cosine 0.98 exactly is 0.998 or more with 16 to 512
directions a part (tests/llm).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.llm.components import components
from wordpair.llm.store import written

BLOCKS, MARGIN = 3, 0.06
#: Directions a part at least, and filters a vector.
LEAST_CODE, FILTERS_A_VECTOR = 64, 4
#: The cosine that MARGIN was measured at.
MARGIN_AT = 0.98
GROUP_ROWS = 4096
#: Vectors of one filter that one task compares with each other, and those decoded at once.
BLOCK = 2048
DECODE_ROWS = 1024


def code_for(n: int, blocks: int = BLOCKS) -> int:
    """Directions a part, so that there are ``FILTERS_A_VECTOR`` filters a vector.  A vector
    passes about code ** 0.5 of them (tests/llm), so a filter holds few."""
    return max(LEAST_CODE, round((FILTERS_A_VECTOR * n) ** (1 / blocks)))


def margin_for(threshold: float, dim: int) -> float:
    """The cap margin.  Inner products of vectors at ``threshold`` differ as the vectors
    do, by sqrt(2 - 2 threshold), and more in few dimensions; the power of the
    dimension is fitted to the recall at 16, 64 and 256 (tests/llm)."""
    if threshold >= MARGIN_AT:
        return MARGIN
    return max(MARGIN, MARGIN * ((1 - threshold) / (1 - MARGIN_AT)) ** 0.5 * (64 / dim) ** 0.25)


class ProductCode:
    def __init__(self, dim: int, blocks: int, code: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), min(blocks, dim))
        self.words = []
        for part in self.parts:
            w = rng.standard_normal((code, len(part)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))

    def decode(self, unit: np.ndarray, margin: float) -> list[np.ndarray]:
        """Filters each row passes (ascending)."""
        turned = unit @ self.rotation
        # how far below the part's best direction each one is
        loss = []
        for part, words in zip(self.parts, self.words, strict=True):
            s = turned[:, part] @ words.T
            loss.append(s.max(axis=1, keepdims=True) - s)
        out = []
        for i in range(len(unit)):
            spent, filters = np.zeros(1), np.zeros(1, np.int64)
            for part in loss:
                near = np.flatnonzero(part[i] <= margin)
                total = spent[:, None] + part[i][near][None, :]
                a, b = np.nonzero(total <= margin)
                spent, filters = total[a, b], filters[a] * len(part[i]) + near[b]
            out.append(np.sort(filters))
        return out


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(unit: np.ndarray, lists: list[np.ndarray], filter_: int, threshold: float,
                 cross: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i < j) of one filter's vectors that are linked and have no
    smaller common filter; ``cross`` (0/1 a row): only pairs from both sides."""
    near = np.triu(unit @ unit.T >= threshold, 1)
    if cross is not None:
        near &= cross[:, None] != cross[None, :]
    i, j = np.nonzero(near)
    if len(i):
        smaller = [x[x < filter_] for x in lists]
        ids, place = np.unique(np.concatenate(smaller), return_inverse=True)
        if len(ids):
            # a bit for each smaller filter; a pair with a bit in common has met there
            has = np.zeros((len(lists), len(ids)), bool)
            has[np.repeat(np.arange(len(lists)), [len(x) for x in smaller]), place] = True
            has = np.packbits(has, axis=1)
            step = max(1, (32 << 20) // has.shape[1])
            first = np.concatenate([~(has[i[at:at + step]] & has[j[at:at + step]]).any(axis=1)
                                    for at in range(0, len(i), step)])
            i, j = i[first], j[first]
    return i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            out.append((a, b))
    return out


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", threshold: float = 0.98, blocks: int = BLOCKS,
                   code: int | None = None, margin: float | None = None, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row a vector.

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine is at least ``threshold``.  A vector that is null,
    empty, zero, or holds null, NaN or infinite components, or has no label, links
    with nothing: its component is its own id.  Rows that repeat an id or a
    vector are vectors of their own.  A component of null ids only has a null
    ``component_id``.  Extra columns are ignored.
    """
    raw = F.col(vector_col)
    v = raw.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), raw.alias("vector"),
        (F.col(label_col).isNotNull() & F.coalesce(~bad & (norm2 > 0), F.lit(False))).alias("fit"))
    # equal vectors share the text of their components
    rows = written(rows.withColumn("h", F.sha2(F.to_json(F.struct("label", "vector")), 256)), "vectors")
    fit = rows.where("fit")
    reps = written(fit.groupBy("h").agg(F.min("vec_id").alias("first_id"),
                                        F.count(F.lit(1)).alias("copies"),
                                        F.min(F.struct("label", "vector")).alias("x"))
                   .select("h", "first_id", "copies", F.monotonically_increasing_id().alias("key"),
                           F.col("x.label").cast("string").alias("label"), "x.vector"), "reps")

    code = code or code_for(reps.count(), blocks)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                some = batch.slice(start, DECODE_ROWS)
                xs = some.column(2).to_pylist()
                lists: list[np.ndarray | None] = [None] * len(xs)
                for dim in {len(x) for x in xs}:
                    at = [i for i, x in enumerate(xs) if len(x) == dim]
                    if dim not in codes:
                        codes[dim] = ProductCode(dim, blocks, code, seed)
                    wide = margin_for(threshold, dim) if margin is None else margin
                    for i, f in zip(at, codes[dim].decode(unit_rows([xs[i] for i in at]), wide), strict=True):
                        lists[i] = f
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([len(x) for x in xs], pa.int32()),
                     pa.array(lists, pa.list_(pa.int64()))], names=["key", "label", "dim", "filters"])

    passed = written(reps.select("key", "label", "vector")
                     .mapInArrow(filters, "key long, label string, dim int, filters array<long>"), "filters")
    narrow = passed.select("key", "label", "dim", F.explode("filters").alias("filter"))
    sizes = narrow.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes, "filter-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // GROUP_ROWS))
    shared = written(narrow.join(sizes, ["label", "dim", "filter"]), "shared-filters")
    # filters that no other vector passes cannot be common ones
    lists = shared.groupBy("key").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    whole = reps.select("key", "copies", "vector").join(lists, "key")
    parts = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    m = (shared.join(whole, "key").withColumn("parts", parts)
         .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    small = m.where("parts = 1").withColumn("other", F.lit(0)) \
        .withColumn("group", F.pmod(F.xxhash64("label", "dim", "filter"), F.lit(groups)))
    # block pairs (low, high) of a large filter: each block goes to every pair it is in
    large = (m.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("group", F.xxhash64("label", "dim", "filter", F.least("part", "other"),
                                             F.greatest("part", "other"))))
    tasks = small.unionByName(large).select("group", "label", "dim", "filter", "parts", "part", "other",
                                            "key", "copies", "vector", "filters")

    def compare(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in
                ("label", "dim", "filter", "parts", "part", "other", "key", "copies")}
        vectors, lists = table.column("vector"), table.column("filters")
        at: dict[tuple, list[int]] = {}
        for r in range(table.num_rows):
            p, o = cols["part"][r], cols["other"][r]
            pair = (min(p, o), max(p, o)) if cols["parts"][r] > 1 else (0, 0)
            at.setdefault((cols["label"][r], cols["dim"][r], cols["filter"][r], *pair), []).append(r)
        degree: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for (_, _, filter_, low, high), rs in at.items():
            if len(rs) < 2:
                continue
            unit = unit_rows([vectors[r].as_py() for r in rs])
            side = np.array([cols["part"][r] == high for r in rs]) if low != high else None
            i, j = linked_pairs(unit, [np.array(lists[r].as_py()) for r in rs], filter_, threshold, side)
            if not len(i):
                continue
            copies = np.array([cols["copies"][r] for r in rs])
            d = np.bincount(i, copies[j], len(rs)) + np.bincount(j, copies[i], len(rs))
            keys = [cols["key"][r] for r in rs]
            for k, n in zip(keys, d.tolist(), strict=True):
                if n:
                    degree[k] = degree.get(k, 0) + int(n)
            edges += [(keys[a], keys[b]) for a, b in _forest(len(rs), i, j)]
        rows = [(k, None, n) for k, n in degree.items()] + [(a, b, None) for a, b in edges]
        return pa.table({n: pa.array([x[c] for x in rows], pa.int64())
                         for c, n in enumerate(("a", "b", "n"))})

    found = written(tasks.groupBy("group").applyInArrow(compare, "a long, b long, n long"), "links")
    linked = found.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b is not null").select("a", "b"))
    reps = (reps.select("h", "key", "first_id", "copies").join(linked, "key", "left")
            .join(roots.withColumnRenamed("node", "key"), "key", "left")
            .withColumn("root", F.coalesce("root", "key")))
    reps = written(reps, "classes")
    least = reps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_hash = reps.join(least, "root").select(
        "h", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    a = rows.where("fit").select("vec_id", "h").join(by_hash, "h")
    b = rows.where("not fit").select("vec_id", F.col("vec_id").alias("component_id"),
                                     F.lit(0).cast("long").alias("n_links"))
    return (a.select("vec_id", "component_id", "n_links").unionByName(b)
            .select("vec_id", "n_links", "component_id",
                    F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
