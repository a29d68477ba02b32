"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios (NB-SVM with a logistic loss).

* Features are the distinct hashed n-grams (3 to 5 bytes) of the whole text.
* Their log-count ratios come from all labelled training rows: each task adds
  up presence counts by class, and fixed-length arrays are summed.
* The weights are fitted on a bounded sample (``per_class`` rows of each class,
  by hash) with L-BFGS; every gradient is a Spark job over the stored sample whose
  tasks' arrays are added up by slices on the executors, so that the driver gets one
  array in small pieces.  The weights go out as a broadcast that is destroyed
  after its step.
* Scoring is one pass over the documents with the weights (1 MB) in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.llm.memory import trimmed
from wordpair.llm.ngrams import Presence, add_up, few_at_once
from wordpair.llm.store import written

ORDERS = (3, 4, 5)
BITS = 18
#: Rows of each class that the weights are fitted on, at most.
PER_CLASS = 4096
#: Tasks of a gradient, and slices in which their arrays are added up.
FIT_TASKS = 8
SLICES = 16


def pack_buckets(found: np.ndarray) -> bytes:
    """Ascending buckets as gaps, two bytes each where they fit."""
    gaps = np.diff(found, prepend=0)
    small = not len(gaps) or gaps.max() < 1 << 16
    return (b"\0" + gaps.astype("<u2").tobytes()) if small else (b"\1" + gaps.astype("<i4").tobytes())


def unpack_buckets(blob) -> np.ndarray:
    data = memoryview(blob)
    return np.cumsum(np.frombuffer(data[1:], "<i4" if data[0] else "<u2"), dtype=np.int64)


def _observe(rows: DataFrame) -> DataFrame:
    """``(label, sampled, text)`` -> per task (``part``) and class one array of presence
    counts (``kind`` 0), and the features of sampled rows (``kind`` 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        presence = Presence(ORDERS, BITS)
        totals: dict[int, list] = {}

        def out(kind, label, n, blobs):
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(blobs), pa.int32()), pa.array(label, pa.string()),
                 pa.array(n, pa.int64()), pa.array(blobs, pa.binary()),
                 pa.array([part] * len(blobs), pa.int64())],
                names=["kind", "label", "n", "counts", "part"])

        for batch in batches:
            labels, blobs = [], []
            for y, sampled, text in few_at_once(batch):
                found = presence(text)
                mine = totals.setdefault(y, [0, np.zeros(1 << BITS, np.int64)])
                mine[0] += 1
                mine[1][found] += 1
                if sampled:
                    labels.append(str(y))
                    blobs.append(pack_buckets(found))
            if blobs:
                yield out(1, labels, [1] * len(blobs), blobs)
        for y, (n, counts) in totals.items():
            yield out(0, [str(y)], [n], [counts.tobytes()])

    return rows.mapInArrow(trimmed(run), "kind int, label string, n long, counts binary, part long")


def log_ratios(counts: dict[str, tuple[int, np.ndarray]], alpha: float = 1.0) -> np.ndarray:
    p, q = (counts[y][1] + alpha if y in counts else np.full(1 << BITS, alpha) for y in "10")
    return np.log(p / p.sum()) - np.log(q / q.sum())


def lbfgs(loss_grad, x: np.ndarray, steps: int = 25, memory: int = 8, tol: float = 1e-4) -> np.ndarray:
    """Minimise a smooth convex function of ``x`` (backtracking line search)."""
    f, g = loss_grad(x)
    s_y: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.linalg.norm(g) <= tol * max(1.0, np.linalg.norm(x)):
            break
        d = -g
        used = []
        for s, y, rho in reversed(s_y):
            a = rho * (s @ d)
            d = d - a * y
            used.append(a)
        if s_y:
            s, y, _ = s_y[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y, rho), a in zip(s_y, reversed(used), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope, t = g @ d, 1.0
        while True:
            f2, g2 = loss_grad(x + t * d)
            if f2 <= f + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = t * d, g2 - g
        if s @ y > 1e-12:
            s_y = [*s_y[1 - memory:], (s, y, 1.0 / (s @ y))]
        if f - f2 <= 1e-7 * max(1.0, abs(f)):
            x, f, g = x + s, f2, g2
            break
        x, f, g = x + s, f2, g2
    return x


def _add_slices(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(g.as_buffer()) for g in table.column("g")], axis=0)
    return pa.table({"slice": table.column("slice")[:1], "g": pa.array([total.tobytes()], pa.binary())})


def _loss_grad(sample: DataFrame, ratios: np.ndarray, n_by_class: dict[int, int], l2: float):
    """Balanced logistic loss and its gradient, summed over the stored sample."""
    share = {y: 0.5 / max(1, n) for y, n in n_by_class.items()}
    context = sample.sparkSession.sparkContext

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        # a closure, so that this step's job holds the broadcast and nothing larger
        sent, b = context.broadcast((x[:-1] * ratios).astype(np.float32)), float(x[-1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = sent.value
            loss, grad, bias = 0.0, np.zeros(len(w)), 0.0
            for batch in batches:
                for label, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = unpack_buckets(blob.as_buffer())
                    y = int(label)
                    m = (1 if y else -1) * (float(w[found].sum(dtype=np.float64)) + b)
                    loss += share[y] * float(np.logaddexp(0.0, -m))
                    k = -share[y] * (1 if y else -1) / (1.0 + np.exp(min(m, 700.0)))
                    grad[found] += k
                    bias += k
            parts = np.array_split(np.concatenate([grad, [bias, loss]]), SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([g.tobytes() for g in parts], pa.binary())],
                names=["slice", "g"])

        got = (sample.select("label", "counts").mapInArrow(run, "slice int, g binary")
               .groupBy("slice").applyInArrow(_add_slices, "slice int, g binary").collect())
        sent.destroy()
        total = np.concatenate([np.frombuffer(bytes(r["g"])) for r in sorted(got, key=lambda r: r["slice"])])
        return (float(total[-1] + 0.5 * l2 * (x[:-1] @ x[:-1])),
                np.append(total[:-2] * ratios + l2 * x[:-1], total[-2]))

    return at


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: int = PER_CLASS, l2: float = 1e-4,
        seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights (one a bucket, already times the log-count ratio) and bias.

    Labels that are null or neither 0 nor 1, and labelled ids without a document,
    are not learnt from.  An id labelled several times counts each time.  With no
    labelled row at all the weights are 0 (every score is 0.5)."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id is not null and label in (0, 1)"))
    order = F.xxhash64("id", F.lit(seed))
    picked = None
    for y in (0, 1):
        top = marked.where(F.col("label") == y).select("id").distinct().orderBy(order, "id").limit(per_class)
        top = top.withColumn("label", F.lit(y))
        picked = top if picked is None else picked.unionByName(top)
    marked = marked.join(picked.withColumn("sampled", F.lit(True)), ["id", "label"], "left")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    seen = written(_observe(texts.join(marked, "id")
                            .select("label", F.coalesce("sampled", F.lit(False)), "text")), "toxic")
    counts = {row["label"]: (row["n"], np.frombuffer(bytes(row["counts"]), np.int64))
              for row in add_up(seen.where("kind = 0")).collect()}
    x = np.zeros((1 << BITS) + 1)
    if not counts:
        return x[:-1], 0.0
    ratios = log_ratios(counts)
    sample = seen.where("kind = 1").select("label", "counts").coalesce(FIT_TASKS)
    n = {int(row["label"]): row["count"] for row in sample.groupBy("label").count().collect()}
    x = lbfgs(_loss_grad(sample, ratios, n, l2), x)
    return x[:-1] * ratios, float(x[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text",
          score_col: str = "toxic_score") -> DataFrame:
    """``docs`` plus ``score_col`` (probability of label 1, from the text alone), which
    takes the place of a column of that name.  A null text scores as an empty one."""
    weights, bias = model[0].astype(np.float32), model[1]
    cols = docs.columns
    schema = docs.select(*[F.col(f"`{c}`") for c in cols if c != score_col]).schema
    names = schema.names
    place = names.index(text_col)
    # columns go by their places: Python functions do not take names with dots
    numbered = [f"c{i}" for i in range(len(names))]
    ddl = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(numbered, schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(ORDERS, BITS)
        for batch in batches:
            z = [float(weights[presence(t)].sum(dtype=np.float64)) + bias
                 for t, in few_at_once(batch.select([place]))]
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())],
                                             names=[*numbered, "score"])

    return (docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, numbered, strict=True)])
            .mapInArrow(trimmed(run), ddl + ", score double").toDF(*names, score_col))
