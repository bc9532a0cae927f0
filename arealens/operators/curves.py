"""Lorenz curves and what is read off them. Running sums go chunk by chunk of the score, so one curve is no single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.ranks import running_sum


def lorenz(df: DataFrame, score: str, outcome: str, weight: str, by: Sequence[str], key: str, chunks: int = 256) -> DataFrame:
    """Rows by falling score (ties by key) with x and y: cumulative shares of weight and outcome, and x0, y0 before the row."""
    limits = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.sum(weight).alias("_w"), F.sum(outcome).alias("_o"))
    rows = df.select(*by, key, score, outcome, weight).withColumn("_down", -F.col(score)).join(F.broadcast(limits), list(by))
    place = F.floor(F.coalesce(F.try_divide(F.col("_hi") - F.col(score), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * chunks)
    rows = running_sum(rows.withColumn("_at", place), by, ["_down", key], weight, "_cw", chunk=F.col("_at"))
    rows = running_sum(rows, by, ["_down", key], outcome, "_co", chunk=F.col("_at"))
    share = lambda c, t: F.try_divide(F.col(c).cast("double"), F.col(t))
    return rows.select(*by, key, score, outcome, weight, share("_cw", "_w").alias("x0"), share("_co", "_o").alias("y0"), F.try_divide((F.col("_cw") + F.col(weight)).cast("double"), F.col("_w")).alias("x"), F.try_divide((F.col("_co") + F.col(outcome)).cast("double"), F.col("_o")).alias("y"))


def gini(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Twice the area under the curve by trapezoids, less 1."""
    return curve.groupBy(*by).agg((F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0"))) - 1).alias("gini"))


def capture_at(curve: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """The curve's y at x = q, interpolated on the step that spans it."""
    step = curve.where((F.col("x0") < q) & (F.col("x") >= q))
    y = F.col("y0") + (F.col("y") - F.col("y0")) * F.try_divide(F.lit(q) - F.col("x0"), F.col("x") - F.col("x0"))
    return step.groupBy(*by).agg(F.max(y).alias("capture"))


def share_needed(df: DataFrame, value: str, key: str, goals: Sequence[int], chunks: int = 1024) -> DataFrame:
    """(goal, top_pct): the least percentage of rows, taken by falling whole-number ``value`` and rising key, that holds ``goal`` percent of its sum."""
    total = df.agg(F.count("*").alias("_n"), F.sum(value).alias("_all"), F.max(value).alias("_top"))
    spread = df.crossJoin(F.broadcast(total)).withColumns({"_down": -F.col(value), "_one": F.lit(1).cast("long"), "_at": F.floor((F.col("_top") - F.col(value)) * (chunks - 1) / F.greatest("_top", F.lit(1)))})  # one row
    placed = running_sum(spread, [], ["_down", key], "_one", "_before", chunk=F.col("_at"))
    placed = running_sum(placed.withColumn("_at", F.floor((F.col("_top") - F.col(value)) * (chunks - 1) / F.greatest("_top", F.lit(1)))), [], ["_down", key], value, "_sum", chunk=F.col("_at"))
    reached = placed.withColumn("goal", F.explode(F.array(*map(F.lit, goals)))).where(100 * (F.col("_sum") + F.col(value)) >= F.col("goal") * F.col("_all"))
    return reached.groupBy("goal").agg((100.0 * F.min(F.col("_before") + 1) / F.max("_n")).alias("top_pct"))
