"""Incremental pair counts over a stream of new sequences.

New documents arrive as files in a folder; each micro-batch is split,
encoded against a fixed vocabulary and counted with the same window pairs
operator.  With ``boundary='sequence'`` documents are independent, so counts
of batches add up exactly.

A batch appends its own counts as a run ``<table>/run=<id>-<id>``, sorted by pair:
nothing that was written before is read, and a batch retried after a failure writes
the same folder again.  Runs are merged by levels: as soon as ``FAN`` runs that
follow each other hold equally many batches, one job adds them up into a run of
all their batches, and only then are they deleted.  After n batches there are at most
FAN - 1 runs a level, so reading adds up some FAN log(n) runs, and a count is
rewritten once a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordpair.operators.cooccur import cooccurrence, merge_counts
from wordpair.sources.corpus import document_tokens
from wordpair.session import discard, hadoop_fs
from wordpair.sources.stages import stage_exists

#: Runs of a level that are merged into one of the next.
FAN = 8


def update_pairs(batch: DataFrame, batch_id: int, vocab: DataFrame, table_path: str,
                 window: int = 10) -> None:
    counts = cooccurrence(document_tokens(batch), vocab, window)
    _write_run(counts, _run(table_path, batch_id, batch_id))
    merge_levels(batch.sparkSession, table_path)


def start_incremental_pairs(spark: SparkSession, source_dir: str, schema: str, vocab: DataFrame,
                            table_path: str, checkpoint: str, window: int = 10,
                            once: bool = True):
    """Structured Streaming query: parquet files in ``source_dir`` with
    ``(doc_id, text)`` -> one folder of pair counts per batch under ``table_path``."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    w = (stream.select("doc_id", "text").writeStream
         .foreachBatch(lambda df, bid: update_pairs(df, bid, vocab, table_path, window))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w
    return w.start()


def _run(table_path: str, first: int, last: int) -> str:
    return f"{table_path}/run={first}-{last}"


def _write_run(counts: DataFrame, path: str) -> None:
    counts.repartitionByRange("w1", "w2").sortWithinPartitions("w1", "w2").write.mode("overwrite").parquet(path)


def _listed(spark: SparkSession, table_path: str) -> list[tuple[int, int]]:
    """Complete runs as (first, last) batch, those with more batches first."""
    fs, p = hadoop_fs(spark, table_path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    runs = [tuple(map(int, n.split("=")[1].split("-"))) for n in names if n.startswith("run=")]
    return sorted((r for r in runs if stage_exists(spark, _run(table_path, *r))), key=lambda r: (r[0] - r[1], r[0]))


def _covering(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that count, in order: a run inside another was merged into it."""
    kept: list[tuple[int, int]] = []
    for r in runs:
        if not any(k[0] <= r[0] and r[1] <= k[1] for k in kept):
            kept.append(r)
    return sorted(kept)


def _merge(spark: SparkSession, table_path: str, runs: list[tuple[int, int]]) -> None:
    _write_run(_added_up(spark, table_path, runs), _run(table_path, runs[0][0], runs[-1][1]))
    for r in runs:
        discard(spark, _run(table_path, *r))


def merge_levels(spark: SparkSession, table_path: str, fan: int = FAN) -> None:
    """Merge full levels until none is left; leftovers of a merge that was broken off
    are deleted first."""
    runs = _listed(spark, table_path)
    for r in set(runs) - set(_covering(runs)):
        discard(spark, _run(table_path, *r))
    while True:
        runs = _covering(_listed(spark, table_path))
        tail = []   # the last runs, as long as they hold equally many batches
        for r in reversed(runs):
            if tail and tail[0][1] - tail[0][0] != r[1] - r[0]:
                break
            tail.insert(0, r)
        if len(tail) < fan:
            return
        _merge(spark, table_path, tail[:fan])


def _added_up(spark: SparkSession, table_path: str, runs: list[tuple[int, int]]) -> DataFrame:
    return merge_counts(*(spark.read.parquet(_run(table_path, *r)).select("w1", "w2", "x") for r in runs))


def latest_pairs(spark: SparkSession, table_path: str) -> DataFrame:
    """``(w1, w2, x)`` over all batches so far."""
    runs = _covering(_listed(spark, table_path))
    if not runs:
        raise FileNotFoundError(table_path)
    return _added_up(spark, table_path, runs)


def compact(spark: SparkSession, table_path: str) -> str:
    """Merge the counts of all batches so far into one run."""
    runs = _covering(_listed(spark, table_path))
    if len(runs) > 1:
        _merge(spark, table_path, runs)
    return _run(table_path, runs[0][0], runs[-1][1])
