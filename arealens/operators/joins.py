"""Joins whose broadcast side is measured first, and that keep frequent keys out of single tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes that are broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 16_000_000
#: Keys that are joined by broadcast because each holds at least this share of all rows; there can be no more than 1 / share of them.
HEAVY = 1 / 50_000


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


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def join_keyed(large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", weight: str | None = None) -> DataFrame:
    """``large`` joined with ``small``, which has one row a key; null keys match null keys, other columns of ``small`` are added.

    Up to BROADCAST_BYTES ``small`` is broadcast. Beyond it both are shuffled; where ``weight`` names the column of ``small`` that counts
    the key's rows in ``large``, keys with a share of HEAVY or more of these are broadcast all the same, so that no task gathers the rows of a
    frequent key. ``small`` is read more than once; ``weight`` is left out of the result.
    """
    names = {k: f"_on_{k}" for k in on}
    right = small.withColumnsRenamed(names)
    equal = F.lit(True)
    for k, n in names.items():
        equal &= large[k].eqNullSafe(F.col(n))
    gone = [*names.values(), *([weight] if weight else [])]
    if table_bytes(small) <= BROADCAST_BYTES:
        return large.join(F.broadcast(right), equal, how).drop(*gone)
    if weight is None:
        return large.join(right, equal, how).drop(*gone)
    least = (small.agg(F.sum(weight)).first()[0] or 0) * HEAVY
    heavy, light = right.where(F.col(weight) >= least), right.where(F.col(weight) < least)
    rest = large.join(F.broadcast(heavy.select(*names.values())), equal, "left_anti")
    return large.join(F.broadcast(heavy), equal).drop(*gone).unionByName(rest.join(light, equal, how).drop(*gone))
