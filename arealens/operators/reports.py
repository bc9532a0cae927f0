"""Summaries of columns, histograms and correlations that endure nulls and constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealens.operators.ranks import quantiles


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the pairs without nulls; null where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def skew(value: Column) -> Column:
    """Bias-corrected skewness; null under three values or without spread."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column n, missing, mean, sample deviation, quartiles and skewness; sums from one pass, quartiles from counted values."""

    def cell(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), (F.count("*") - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), skew(v).alias("skew"))

    sums = df.agg(F.array(*map(cell, columns)).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    middle = quantiles(df, [], columns, [0.25, 0.5, 0.75]).select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return sums.join(F.broadcast(middle), "column", "left")  # one row a column


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bins 1 to ``bins`` of equal width over [low, high), 0 below and bins + 1 from ``high`` on; nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns over the rows that have both, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(F.col(a), F.col(b)).alias("r")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def partial_corr(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y given z; null where z settles one of them."""
    return F.try_divide(xy - xz * yz, F.nullif(F.sqrt((1 - xz * xz) * (1 - yz * yz)), F.lit(0.0)))


def fill_from_levels(df: DataFrame, value: str, weight: str, levels: Sequence[str]) -> DataFrame:
    """``df`` with missing values taken from the weighted mean of the first of ``levels`` that has one."""
    out, found = df, [F.col(value)]
    for k, level in enumerate(levels):
        mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))
        out = out.join(df.groupBy(level).agg(mean.alias(f"_m{k}")), level, "left")
        found.append(F.col(f"_m{k}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"_m{k}" for k in range(len(levels))])
