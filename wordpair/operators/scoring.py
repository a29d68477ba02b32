"""Dense products between word vectors and query vectors.

Scoring every word against every query (analogy search, partition functions,
emission probabilities) is a dense matrix product.  It is one-sided: vectors stay
where they are stored and are never exchanged or copied.  Queries are cut into
blocks of at most ``QUERY_BYTES``; a block is broadcast, one job runs over the
vectors with it, and it is destroyed before the next one.  A task multiplies batch
by batch and keeps only reduced numbers for each query of the block (a partial sum,
a best candidate, the top k), which it gives out once, at its end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.session import materialize, release, scratch_folder

#: Bytes of query vectors (double precision) that go to every task at once: the bound
#: of a broadcast and of what passes through the driver.
QUERY_BYTES = 32 << 20
CELL_SCORES = 1 << 18     # scores of a product held at once in a task (a processor's cache)
DRAW_CELLS = (512, 256)   # words x queries of a draw's noise held at once


def to_matrix(arr) -> np.ndarray:
    """pyarrow list column -> (n, d) float64 matrix."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks else pa.array([], type=arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1)


def col_np(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (vectorised, wraps mod 2^64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def uniform01(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A uniform in (0, 1) from (seed, a, b) -- independent of blocking."""
    return as_uniform(bits53(seed, a, b))


def bits53(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 53 bits that ``uniform01`` is made of; ``a`` and ``b`` broadcast."""
    with np.errstate(over="ignore"):
        h = mix64(np.uint64(seed) * _G + mix64(a.astype(np.uint64) * _G + b.astype(np.uint64)))
    return h >> np.uint64(11)


def as_uniform(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float64) + 0.5) / float(1 << 53)


def query_slices(n_words: int, n_queries: int) -> list[slice]:
    """Slices of the queries whose scores against ``n_words`` fit CELL_SCORES."""
    step = max(1, CELL_SCORES // max(1, n_words))
    return [slice(a, min(a + step, n_queries)) for a in range(0, n_queries, step)]


def top_rows(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """Rows of the k largest scores of each column, largest first, ties by row."""
    n, s = scores.shape
    k = min(k, n)
    least = np.partition(scores, n - k, axis=0)[n - k]
    out = []
    for j in range(s):
        rows = np.flatnonzero(scores[:, j] >= least[j])
        out.append(rows[np.lexsort((rows, -scores[rows, j]))[:k]])
    return out


# ------------------------------------------------------------------ one-sided runs
class Block:
    """A block of queries: ids, vectors, and further columns by name."""

    def __init__(self, table: pa.Table, qid: str, qcol: str):
        table = table.sort_by(qid)
        self.qid = table.column(qid).to_numpy().astype(np.int64)
        self.Q = to_matrix(table.column(qcol))
        self.more = {c: table.column(c).to_numpy() for c in table.column_names if c not in (qid, qcol)}

    def part(self, some: slice) -> Block:
        """The same for some of the queries."""
        out = object.__new__(Block)
        out.qid, out.Q = self.qid[some], self.Q[some]
        out.more = {c: v[some] for c, v in self.more.items()}
        return out


def query_blocks(queries: DataFrame, qid: str, qcol: str) -> Iterator[Block]:
    """Blocks of stored queries, each at most about QUERY_BYTES."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qcol)).alias("d")).first()
    n = math.ceil(size["n"] * max(1, size["d"] or 1) * 8 / QUERY_BYTES)
    for i in range(n):
        mine = queries if n == 1 else queries.where(F.pmod(F.xxhash64(qid), F.lit(n)) == i)
        block = Block(mine.toArrow(), qid, qcol)
        if len(block.qid):
            yield block


def one_sided(vectors: DataFrame, queries: DataFrame, reducer: Callable, schema: str, label: str,
              vcol: str = "v", qid: str = "qid", qcol: str = "c") -> DataFrame:
    """Stored rows of ``reducer`` over all (vector, query) products.

    ``reducer(block)`` is made once a task and block; ``add(ids, V)`` takes batches of
    vectors with ascending ids inside, ``table()`` gives the rows of ``schema``.  Vectors with
    ids in any order; a query without a vector, or no query, gives no rows."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col(vcol).alias("v"))
    q = materialize(queries, "queries")
    folder = scratch_folder(spark, label)
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in query_blocks(q, qid, qcol):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            reduced = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                reduced = reduced or reducer(sent.value)
                ids = batch.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                reduced.add(ids[order], to_matrix(batch.column(1))[order])
            if reduced:
                yield from reduced.table().to_batches()

        v.mapInArrow(run, schema).write.mode("append").parquet(folder)
        sent.destroy()
    release(q)
    return spark.read.schema(schema).parquet(folder)


class ExpSum:
    """Partial partition functions sum_w exp(<v_w, c>)."""

    schema = "qid long, z double"

    def __init__(self, block: Block):
        self.block, self.z = block, np.zeros(len(block.qid))

    def add(self, ids: np.ndarray, V: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            for s in query_slices(len(V), len(self.z)):
                self.z[s] += np.exp(V @ self.block.Q[s].T).sum(axis=0)

    def table(self) -> pa.Table:
        return pa.table({"qid": self.block.qid, "z": self.z})


class TopK:
    """The k best words of each query (score descending, id ascending).

    NaN scores never rank (as with a strict '>' scan), nor do the ids in the columns
    ``exclude`` of the query."""

    schema = "qid long, id int, score double"

    def __init__(self, block: Block, k: int, exclude: tuple[str, ...] = ()):
        self.block, self.k = block, k
        self.out = [block.more[c].astype(np.int64) for c in exclude]
        self.ids = np.zeros((k, len(block.qid)), np.int64)
        self.scores = np.full((k, len(block.qid)), -np.inf)

    def add(self, ids: np.ndarray, V: np.ndarray) -> None:
        for part in query_slices(len(V), len(self.block.qid)):
            self.take(ids, V @ self.block.Q[part].T, np.arange(part.start, part.stop))

    def take(self, ids: np.ndarray, scores: np.ndarray, which: np.ndarray) -> None:
        """Put ``scores`` (words x queries ``which``) into what is held."""
        for out in self.out:
            at = np.searchsorted(ids, out[which])
            hit = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == out[which]))
            # a word may be there more than once
            for j in hit.tolist():
                a, b = np.searchsorted(ids, out[which[j]]), np.searchsorted(ids, out[which[j]], side="right")
                scores[a:b, j] = -np.inf
        # only queries whose best new word may enter are looked at; a NaN shows in the maximum
        best = scores.max(axis=0)
        if np.isnan(best).any():
            scores[np.isnan(scores)] = -np.inf
            best = scores.max(axis=0)
        enters = np.flatnonzero((best >= self.scores[-1, which]) & (best > -np.inf))
        for j, top in zip(enters.tolist(), top_rows(scores[:, enters], self.k), strict=True):
            q = which[j]
            s = np.concatenate([self.scores[:, q], scores[top, j]])
            i = np.concatenate([self.ids[:, q], ids[top]])
            best = np.lexsort((i, -s))[:self.k]
            self.scores[:, q], self.ids[:, q] = s[best], i[best]

    def table(self) -> pa.Table:
        rank, q = np.nonzero(self.scores > -np.inf)
        return pa.table({"qid": self.block.qid[q], "id": self.ids[rank, q].astype(np.int32),
                         "score": self.scores[rank, q]})


class SoftmaxParts(TopK):
    """Per query and task (``vb``): the largest logit ``m``, sum exp(logit - m) and the
    top k candidates."""

    schema = "qid long, vb int, id int, logit double, m double, se double"

    def __init__(self, block: Block, k: int):
        super().__init__(block, k)
        self.m = np.full(len(block.qid), -np.inf)
        self.se = np.zeros(len(block.qid))

    def add(self, ids: np.ndarray, V: np.ndarray) -> None:
        for part in query_slices(len(V), len(self.block.qid)):
            S = V @ self.block.Q[part].T
            m = np.maximum(self.m[part], S.max(axis=0))
            self.se[part] = self.se[part] * np.exp(self.m[part] - m) + np.exp(S - m).sum(axis=0)
            self.m[part] = m
            self.take(ids, S, np.arange(part.start, part.stop))

    def table(self) -> pa.Table:
        from pyspark import TaskContext
        rank, q = np.nonzero(self.scores > -np.inf)
        return pa.table({"qid": self.block.qid[q],
                         "vb": pa.array(np.full(len(q), TaskContext.get().partitionId(), np.int32)),
                         "id": self.ids[rank, q].astype(np.int32), "logit": self.scores[rank, q],
                         "m": self.m[q], "se": self.se[q]})


class GumbelMax(TopK):
    """One draw per query from softmax(<v_w, c>) by the Gumbel-max trick."""

    def __init__(self, block: Block, seed: int):
        super().__init__(block, 1)
        self.seed = seed

    def add(self, ids: np.ndarray, V: np.ndarray) -> None:
        for at in range(0, len(ids), DRAW_CELLS[0]):
            some, W = ids[at:at + DRAW_CELLS[0]], V[at:at + DRAW_CELLS[0]]
            for q in range(0, len(self.block.qid), DRAW_CELLS[1]):
                self.draw(some, W, slice(q, q + DRAW_CELLS[1]))

    def draw(self, ids: np.ndarray, V: np.ndarray, part: slice) -> None:
        """Noise grows with its bits, so a word whose bits are too few for even the
        largest logit to reach the query's best word needs no logarithms."""
        S = V @ self.block.Q[part].T
        held, held_id = self.scores[0, part], self.ids[0, part]
        bits = bits53(self.seed, self.block.qid[part][None, :], ids[:, None])
        with np.errstate(invalid="ignore", over="ignore"):
            # a margin far above the rounding of both exponentials
            u = np.exp(-np.exp(-(held - S.max(axis=0) - 1e-6))) * (1 - 1e-9)
        least = np.maximum(np.nan_to_num(u) * float(1 << 53) - 16, 0).astype(np.uint64)
        cells = np.flatnonzero(bits >= least)
        scores = np.full(S.shape, -np.inf)
        scores.ravel()[cells] = S.ravel()[cells] - np.log(-np.log(as_uniform(bits.ravel()[cells])))
        if np.isnan(scores.max(axis=0)).any():
            scores[np.isnan(scores)] = -np.inf
        row = scores.argmax(axis=0)   # the first of equals: ids ascend
        new, new_id = scores[row, np.arange(len(row))], ids[row]
        wins = (new > held) | ((new == held) & (new > -np.inf) & (new_id < held_id))
        held[wins], held_id[wins] = new[wins], new_id[wins]
