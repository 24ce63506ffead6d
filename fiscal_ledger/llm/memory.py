"""Giving memory back: Spark keeps Python workers for later tasks, and a worker keeps what its libraries have pooled."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Tasks a core is given where a short list of files is dealt out.
TASKS_PER_CORE = 4


def release() -> None:
    """Return unused memory of this process to the system, where the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(of: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A batch function that gives memory back at the end of its task, before the worker waits for the next."""

    def run(batches: Iterable) -> Iterator:
        try:
            yield from of(batches)
        finally:
            release()

    return run


def dealt(files: DataFrame) -> DataFrame:
    """A list of files dealt out row by row, so that tasks read a few each.

    The list itself is tiny, and adaptive execution would merge it into one task; a stated number of
    partitions is left alone.
    """
    most = TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(files.count(), most)))
