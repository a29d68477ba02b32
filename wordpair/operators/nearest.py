"""Exact top-k search by cosine over cells of vectors, most of which are skipped.

Vectors are dealt to the nearest of some sampled centres and stored in order of
cell, once.  A cell knows its cone: the angle between its centre and the farthest of
its vectors.  For a query at angle t to the centre no vector of the cell has a
cosine above cos(t - cone) (the triangle inequality of angles).  A search first looks
into the cells nearest to each query, which gives the k-th best score so far; cells
whose bound is below it cannot hold a better word and are not looked into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.operators.analogy import ASKED, eligible_questions, ranked, targets, unit_vectors
from wordpair.operators.scoring import Block, TopK, query_blocks, to_matrix
from wordpair.session import discard, materialize, release, scratch_folder

#: Centres (and cells) at most: they go to every task.
MOST_CELLS = 1024
#: Queries whose bounds are held at once.
QUERIES = 4096
#: Bounds are larger by this, against rounding.
MARGIN = 1e-7


@dataclass(frozen=True)
class Cells:
    """Unit vectors stored by cell: ``table(cell, id, vn)``, centres, cones and sizes."""

    table: DataFrame
    centres: np.ndarray
    cones: np.ndarray
    sizes: np.ndarray

    def bounds(self, Q: np.ndarray) -> np.ndarray:
        """Upper bound of any cosine between a query and a cell (queries x cells)."""
        angle = np.arccos(np.clip(Q @ self.centres.T, -1.0, 1.0))
        return np.cos(np.maximum(0.0, angle - self.cones[None, :])) + MARGIN


def build_cells(unit: DataFrame, n_cells: int | None = None, seed: int = 0) -> Cells:
    """``unit(id, vn)`` by cell.  Centres are vectors with the least hash of their id;
    words without a direction (a zero or NaN vector) never rank and are left out.
    ``n_cells`` is about the root of the number of words by default."""
    spark = unit.sparkSession
    unit = unit.where(F.size("vn") > 0)
    n = unit.count()
    n_cells = max(1, min(MOST_CELLS, n_cells or round(n ** 0.5)))
    chosen = unit.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n_cells).toArrow()
    centres = to_matrix(chosen.column("vn")) if chosen.num_rows else np.zeros((0, 0))
    if len(centres):
        centres = np.unique(centres[np.isfinite(centres).all(axis=1)], axis=0)
    if not len(centres):
        return Cells(unit.limit(0).select(F.lit(0).alias("cell"), "id", "vn"), np.zeros((0, 0)), np.zeros(0),
                     np.zeros(0, np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            V = to_matrix(b.column(1))
            good = np.flatnonzero(np.isfinite(V).all(axis=1))
            near = V[good] @ centres.T
            cell = near.argmax(axis=1)
            kept = b.take(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), kept.column(0), kept.column(1), pa.array(near.max(axis=1))],
                names=["cell", "id", "vn", "near"])

    dealt = unit.select(F.col("id").cast("long").alias("id"), F.col("vn").cast("array<double>").alias("vn"))
    dealt = dealt.mapInArrow(deal, "cell int, id long, vn array<double>, near double")
    # ranges of (cell, id) split a cell that many words share
    table = materialize(dealt.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "cells")
    cones, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in table.groupBy("cell").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n")).collect():
        cones[r["cell"]] = np.arccos(np.clip(r["near"] - MARGIN, -1.0, 1.0))
        sizes[r["cell"]] = r["n"]
    return Cells(table.select("cell", "id", "vn"), centres, cones, sizes)


def _first_cells(near: np.ndarray, sizes: np.ndarray, need: int) -> np.ndarray:
    """For each query the nearest cells that together hold ``need`` words."""
    order = np.argsort(-near, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    mask = np.zeros(near.shape, bool)
    np.put_along_axis(mask, order, before < need, axis=1)
    return mask & (sizes > 0)[None, :]


def _look(cells: Cells, block: Block, mask: np.ndarray, k: int, exclude: tuple[str, ...], folder: str) -> None:
    """Append the top k of the marked (query, cell) products."""
    spark = cells.table.sparkSession
    wanted = np.flatnonzero(mask.any(axis=0)).tolist()
    if not wanted:
        return
    sent = spark.sparkContext.broadcast((block, mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mask = sent.value
        best = TopK(block, k, exclude)
        for b in batches:
            if not b.num_rows:
                continue
            cell, ids, V = b.column(0).to_numpy(), b.column(1).to_numpy(), to_matrix(b.column(2))
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                which = np.flatnonzero(mask[:, cell[s]])
                step = max(1, 2_000_000 // (e - s))
                for at in range(0, len(which), step):
                    some = which[at:at + step]
                    best.take(ids[s:e], V[s:e] @ block.Q[some].T, some)
        yield from best.table().to_batches()

    (cells.table.where(F.col("cell").isin(wanted)).mapInArrow(run, TopK.schema)
     .write.mode("append").parquet(folder))
    sent.destroy()


def search(cells: Cells, queries: DataFrame, k: int, exclude: tuple[str, ...] = (), qid: str = "qid",
           qcol: str = "qn") -> tuple[DataFrame, DataFrame]:
    """``(best, work)``: ``(qid, rank, id, score)`` of the k words of highest cosine per
    unit query, and ``(qid, cells, searched)``.  Ties go to the lowest id; queries
    without a direction have no rows in ``best``."""
    spark = queries.sparkSession
    q = materialize(queries, "queries")
    folder, works = scratch_folder(spark, "nearest"), scratch_folder(spark, "nearest-work")
    spark.createDataFrame([], TopK.schema).write.parquet(folder)
    spark.createDataFrame([], "qid long, cells int, searched int").write.parquet(works)
    for whole in query_blocks(q, qid, qcol):
        for at in range(0, len(whole.qid), QUERIES):
            block = whole.part(slice(at, at + QUERIES))
            Q = np.nan_to_num(block.Q)
            real = np.isfinite(block.Q).all(axis=1)
            if not len(cells.centres):
                continue
            first = _first_cells(Q @ cells.centres.T, cells.sizes, k + len(exclude)) & real[:, None]
            mine = scratch_folder(spark, "nearest-first")
            spark.createDataFrame([], TopK.schema).write.parquet(mine)
            _look(cells, block, first, k, exclude, mine)
            # one row a query of the block
            found = ranked(spark.read.schema(TopK.schema).parquet(mine), k).where(F.col("rank") == k)
            least = np.full(len(block.qid), -np.inf)
            for r in found.select("qid", "score").collect():
                least[np.searchsorted(block.qid, r["qid"])] = r["score"]
            spark.read.schema(TopK.schema).parquet(mine).write.mode("append").parquet(folder)
            more = ((cells.bounds(Q) >= least[:, None]) & ~first & real[:, None] & (cells.sizes > 0)[None, :])
            _look(cells, block, more, k, exclude, folder)
            done = (first | more).sum(axis=1).astype(np.int32)
            rows = pa.table({"qid": block.qid, "cells": np.full(len(done), len(cells.centres), np.int32),
                             "searched": done})
            spark.createDataFrame(rows).write.mode("append").parquet(works)
            discard(spark, mine)
    release(q)
    return (ranked(spark.read.schema(TopK.schema).parquet(folder), k),
            spark.read.schema("qid long, cells int, searched int").parquet(works))


def pruned_analogies(vectors: DataFrame, questions: DataFrame, k: int = 5, lowercase: bool = True,
                     cells: Cells | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``analogy_topk`` by pruned search, and the work it took."""
    cells = cells or build_cells(unit_vectors(vectors))
    el = eligible_questions(vectors, questions, lowercase)
    return search(cells, targets(vectors, el), k, ASKED)
