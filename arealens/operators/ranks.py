"""Running sums, ranks and quantiles that never gather a whole group in one task.

Ranks and quantiles are worked out on counted values: a group's equal values are one row, however many rows have them. Its distinct values
are laid out in chunks of about equal numbers, whose bounds come from a mergeable sketch, and a running sum of the counts goes over the chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealens.operators.joins import join_keyed
from arealens.scratch import discard, stage


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str, chunk: Column | None = None, chunks: int = 1024) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows before this one in its group (exclusive).

    A group is laid out by ``chunk`` (default: a hash of ``order`` over ``chunks`` values) and, within a
    chunk, by ``order``. Chunks are summed first, so a group with a third of all rows is spread over
    ``chunks`` tasks; rows tied on ``order`` must be interchangeable. Null keys form a group; a null
    ``value`` counts as 0. A column of ``df`` named ``into`` is replaced; ``_chunk``, ``_base``, ``_local``, ``_total``, ``_c`` and names that begin with ``_k_`` are used within.
    """
    df = df.drop(into).withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)) if chunk is None else chunk)
    amount = F.coalesce(F.col(value), F.lit(0))
    totals = df.groupBy(*keys, "_chunk").agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    on = F.col("_chunk") == F.col("_c")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(bases, on, "left").withColumn(into, F.col("_local") + F.col("_base")).drop("_chunk", "_c", "_base", "_local", *[f"_k_{k}" for k in keys])


def counted_values(df: DataFrame, by: Sequence[str], columns: Sequence[str], chunks: int = 64) -> DataFrame:
    """(by, _column, _value, _k, _before, _n): each distinct value of each column in each group, as a double, with how many rows have it, have
    less, and have any. Null values are left out, NaN is the greatest; null keys form a group."""
    cells = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])
    melted = df.select(*by, F.explode(cells).alias("_v")).select(*by, "_v.*").where("_value is not null")
    counts = stage(melted.groupBy(*by, "_column", "_value").agg(F.count("*").alias("_k")), "value_counts")
    shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    groups = stage(counts.groupBy(*by, "_column").agg(F.percentile_approx("_value", shares, F.lit(20 * chunks)).alias("_cuts"), F.sum("_k").alias("_n"), F.count("*").alias("_rows")), "value_groups")
    placed = join_keyed(counts, groups, [*by, "_column"], weight="_rows")
    placed = placed.withColumn("_at", F.size(F.filter("_cuts", lambda c: c < F.col("_value")))).drop("_cuts")
    out = stage(running_sum(placed, [*by, "_column"], ["_value"], "_k", "_before", chunk=F.col("_at")).drop("_at"), "counted_values")
    discard(counts, groups)
    return out


def mean_ranks(df: DataFrame, by: Sequence[str], into: Mapping[str, str]) -> DataFrame:
    """``df`` with a column for each pair (column, name) of ``into``: the mean rank of ties among the group's values over their number; null for null.

    Columns are ranked as doubles. A column that has a new name is replaced; names _value0, _value1 and so on are reserved.
    """
    counted = counted_values(df, by, list(into))
    share = (F.col("_before") + (F.col("_k") + 1) / 2) / F.col("_n")
    out = df.withColumns({f"_value{i}": F.col(c).cast("double") for i, c in enumerate(into)}).drop(*into.values())
    for i, (c, name) in enumerate(into.items()):
        own = counted.where(F.col("_column") == c).select(*by, F.col("_value").alias(f"_value{i}"), "_k", share.alias(name))
        out = join_keyed(out, own, [*by, f"_value{i}"], "left", weight="_k").drop(f"_value{i}")
    return out


def quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, column, n, q): exact quantiles of each column in each group, between the two nearest values in proportion; one row for a group and
    column with values. ``q`` has one number for each of ``shares``."""

    def at(share: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(share))
        holds = lambda x: (F.col("_before") <= x) & (x < F.col("_before") + F.col("_k"))
        low, high = (F.max(F.when(holds(f(place)), F.col("_value"))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        return low + F.when(part > 0, part * (high - low)).otherwise(0.0)

    found = counted_values(df, by, columns).groupBy(*by, F.col("_column").alias("column")).agg(F.max("_n").alias("n"), F.array(*map(at, shares)).alias("q"))
    return found


def medians(df: DataFrame, by: Sequence[str], column: str, into: str) -> DataFrame:
    """(by, into): the median of a column in each group that has values."""
    return quantiles(df, by, [column], [0.5]).select(*by, F.col("q")[0].alias(into))
