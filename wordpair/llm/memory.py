"""Python workers give back what a task no longer uses.

Spark keeps Python workers for later tasks.  Freed memory stays with their
allocators, so a worker would hold the peak of its largest task beside tasks that
run in the JVM.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa


def kept(name: str) -> dict:
    """A dict of this worker process that outlives the task.  The package is shipped to
    workers by value, once a task, so its own modules cannot hold it."""
    module = sys.modules.setdefault("_wordpair_kept", ModuleType("_wordpair_kept"))
    return module.__dict__.setdefault(name, {})


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # no glibc
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
            ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving back memory when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def trimmed_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` for ``applyInArrow``, giving back memory when its group ends."""

    def group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return group
