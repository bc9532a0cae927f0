"""Words and word shingles as Spark expressions.

A word is a run of characters other than space and ``\\t\\n\\v\\f\\r``; null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """array<string> of the words of ``text``; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WHITE[1:], " " * len(WHITE[1:])), " "), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def window_hashes(items: Column, width: int) -> Column:
    """64-bit hashes of every run of ``width`` items, in order; empty if there are fewer items."""
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return let(items, lambda w: F.when(F.size(w) >= width, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``, or a row that has more."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop
        at = stop


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text in ``column``; copies, as the ASCII kernels misread slices."""
    for at, stop in _cuts(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), most):
        yield batch.take(pa.array(np.arange(at, stop)))


def list_slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` values in the lists of ``column``."""
    for at, stop in _cuts(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), most):
        yield batch.slice(at, stop - at)
