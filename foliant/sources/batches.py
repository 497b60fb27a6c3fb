"""Bounds on what a Python worker holds: Arrow batches by bytes, texts by characters, memory given back after a task."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

#: Most bytes of one Arrow batch between Spark and Python, and characters that are worked on at once; one text may be longer.
BATCH_BYTES, PIECE = 4 << 20, 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limit to ``BATCH_BYTES``; a lower limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at_most = spark.conf.get(name, None)
    if not at_most or not at_most.rstrip("bB").isdigit() or not 0 < int(at_most.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving freed memory back to the system at the end of each task: Python workers live on."""

    @functools.wraps(run)
    def to_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return to_end


def pieces(texts: Iterable, most: int | None = None) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most ``most`` characters (``PIECE`` if not given) or one text; what isn't a text is null."""
    most, out, size = most or PIECE, [], 0
    for t in texts:
        t = t if isinstance(t, str) else None
        n = len(t or "") + 1
        if out and size + n > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += n
    if out:
        yield out


def joined(parts: list, empty):
    """One pandas object of a batch's parts; ``empty`` of none."""
    return pd.concat(parts, ignore_index=True) if parts else empty
