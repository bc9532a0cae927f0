"""Joins that broadcast one side only after its rows are counted and their size is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes that are broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 16_000_000


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as broadcast: 24 for the hash table, 8 a number, and what strings and arrays hold."""
    size = F.lit(24)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 8 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 16 + 8 * F.greatest(F.size(f.name), F.lit(0))
        else:
            size = size + 8
    return size


def join_counted(large: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join with ``small`` (a table that is cheap to read twice) broadcast if it has at most BROADCAST_BYTES, else shuffled."""
    held = small.agg(F.sum(row_bytes(small))).first()[0] or 0
    return large.join(F.broadcast(small) if held <= BROADCAST_BYTES else small, on, how)


#: Keys that are joined by broadcast because each holds at least this share of all rows; there can be no more than 1 / share of them.
HEAVY = 1 / 50_000


def join_heavy_apart(large: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """``large`` left-joined with ``small``, which has one row a key and in ``weight`` how many rows of ``large`` have it; without that column.

    Keys with a share of HEAVY or more of all rows are broadcast: their number is bounded by that share, so no task gathers a frequent key's rows.
    The other keys are joined by ``join_counted``. Both tables are read more than once.
    """
    least = large.count() * HEAVY
    if small.where(F.col(weight) < least).isEmpty():
        return large.join(F.broadcast(small.drop(weight)), key, "left")
    heavy = small.where(F.col(weight) >= least).drop(weight)
    rest = join_counted(large.join(F.broadcast(heavy.select(key)), key, "left_anti"), small.where(F.col(weight) < least).drop(weight), key, "left")
    return large.join(F.broadcast(heavy), key).unionByName(rest)
