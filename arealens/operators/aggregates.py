"""Aggregates over areas, groups and neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_counts(df: DataFrame, key: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Rows of each category per key in columns of their own, 0 where there are none, and total_count of all rows, unmapped ones too."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.count_if(F.col(category) == c).alias(f"{c}_count") for c in categories], F.count("*").alias("total_count")
    )


def weighted_mean(df: DataFrame, by: Sequence[str], weight: str, columns: Sequence[str]) -> DataFrame:
    """Per group the weighted mean of each column over the rows where it and the weight are not null."""
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight))))
    return df.groupBy(*by).agg(*[mean(c).alias(c) for c in columns])


def equitability(df: DataFrame, by: str, category: str) -> DataFrame:
    """Shannon equitability of a group's categories: entropy over the log of their number, 0 for one category."""
    counts = df.where(F.col(category).isNotNull()).groupBy(by, category).agg(F.count("*").alias("n"))
    sums = counts.groupBy(by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"), F.count("*").alias("k"))
    entropy = F.log(F.col("t").cast("double")) - F.col("s") / F.col("t")
    return sums.select(by, F.col("k").alias("n_categories"), F.when(F.col("k") <= 1, F.lit(0.0)).otherwise(entropy / F.log(F.greatest(F.col("k"), F.lit(2)).cast("double"))).alias("equitability"))


def neighbour_agg(edges: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Per row of ``values``: neighbours' mean (null if none has a value), sum (nulls as 0) and number, islands kept."""
    met = edges.join(values.select(F.col(key).alias("dst"), F.col(value).alias("_v")), "dst")
    sums = met.groupBy("src").agg(F.avg("_v").alias("neighbour_mean"), F.coalesce(F.sum("_v"), F.lit(0.0)).alias("neighbour_sum"), F.count("*").alias("n_neighbours"))
    return values.select(key).join(sums.withColumnRenamed("src", key), key, "left").select(key, "neighbour_mean", F.coalesce("neighbour_sum", F.lit(0.0)).alias("neighbour_sum"), F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def pooled_lag(edges: DataFrame, values: DataFrame, key: str, numerator: str, denominator: str, scale: float = 100.0) -> DataFrame:
    """``scale`` times the neighbours' summed numerators over their summed denominators; null if these are 0."""
    met = edges.join(values.select(F.col(key).alias("dst"), F.col(numerator).alias("_n"), F.col(denominator).alias("_d")), "dst")
    return met.groupBy(F.col("src").alias(key)).agg((F.try_divide(F.sum("_n").cast("double"), F.sum("_d")) * scale).alias("lag"))


def variance_share(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Per column the share of its variance that lies between groups, from one pass of sums."""
    groups = df.groupBy(by).agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("n", F.count), ("s", F.sum))], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in columns])
    sums = groups.agg(*[x for c in columns for x in (F.sum(f"n_{c}").alias(f"n_{c}"), F.sum(f"s_{c}").alias(f"s_{c}"), F.sum(f"q_{c}").alias(f"q_{c}"), F.sum(F.try_divide(F.pow(f"s_{c}", F.lit(2)), F.col(f"n_{c}"))).alias(f"b_{c}"))])
    mean = lambda c: F.pow(f"s_{c}", F.lit(2)) / F.col(f"n_{c}")
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.try_divide(F.col(f"b_{c}") - mean(c), F.col(f"q_{c}") - mean(c)).alias("eta2")) for c in columns])).alias("r")).select("r.*")


def severity_weighted(df: DataFrame, by: str, year: str, rates: Sequence[str], change: Column, to: int, level: Sequence[str]) -> DataFrame:
    """(by, weighted): the mean of a group's rates relative to the mean of all groups, times the sum of those means over ``level``.

    Each rate is carried to the year ``to`` at ``change`` a year, not below 0, and the highest of a group's years counts. A group that lacks a rate has null.
    """
    moved = df.select(by, *[F.greatest(F.col(c) * (1 + (F.col(year) - to) * change), F.when(F.col(c).isNotNull(), F.lit(0.0))).alias(c) for c in rates])
    highest = moved.groupBy(by).agg(*[F.max(c).alias(c) for c in rates])
    means = highest.agg(*[F.avg(c).alias(f"_u_{c}") for c in rates])
    joined = highest.crossJoin(F.broadcast(means))  # one row
    relative = sum((F.try_divide(F.col(c), F.col(f"_u_{c}")) / len(rates) for c in rates), F.lit(0.0))
    return joined.select(by, (relative * sum((F.col(f"_u_{c}") for c in level), F.lit(0.0))).alias("weighted"))
