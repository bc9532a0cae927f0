"""Scores of runs: tables (city, y, p) of outcomes and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealens.operators.ranks import mean_ranks
from arealens.operators.reports import safe_corr


def ranked(run: DataFrame, *by: str) -> DataFrame:
    """``run`` with ry and rp, the mean ranks of y and p among each group's rows as shares."""
    return mean_ranks(run, by, {"y": "ry", "p": "rp"})


def fit(y: Column, p: Column) -> Column:
    """1 - squared errors over squared deviations; null where y is constant."""
    return 1 - F.try_divide(F.sum(F.pow(y - p, F.lit(2))), F.var_pop(y) * F.count(y))


def scorecard(run: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group of a ``ranked`` run: n, r2, rho, mae, recall10, recall25 and called_safe.

    recall is the share of the worst tenth (quarter) by outcome that is among the worst by prediction, called_safe the share of the
    worst tenth that is predicted in the better half; null where a group has no worst rows.
    """
    at = lambda c, least: F.round(c, 9) >= least
    recall = lambda low: F.try_divide(F.count_if(at("ry", low) & at("rp", low)), F.count_if(at("ry", low)))
    return run.groupBy(*by).agg(
        F.count("*").alias("n"), fit(F.col("y"), F.col("p")).alias("r2"), safe_corr(F.col("ry"), F.col("rp")).alias("rho"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
        recall(0.9).alias("recall10"), recall(0.75).alias("recall25"), F.try_divide(F.count_if(at("ry", 0.9) & (F.round("rp", 9) <= 0.5)), F.count_if(at("ry", 0.9))).alias("called_safe"),
    )


def relevel(run: DataFrame, anchors: DataFrame, weight: float = 1.0) -> DataFrame:
    """``run`` with p moved towards its city's anchor (city, level) by ``weight`` of the ratio; cities without a finite positive anchor stay."""
    means = run.groupBy("city").agg(F.avg("p").alias("_mean"))
    ratio = F.try_divide(F.col("level"), F.col("_mean"))
    moved = run.join(means, "city").join(anchors, "city", "left")
    return moved.withColumn("p", F.when(ratio > 0, F.col("p") * F.pow(ratio, F.lit(weight))).otherwise(F.col("p"))).select(*run.columns)
