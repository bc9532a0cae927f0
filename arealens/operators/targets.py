"""Targets of area models from counts and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions.columns import winsor
from arealens.operators.joins import join_keyed

MODES = ("rate", "rate_daytime", "logcount", "lograte", "rate_within_city", "rate_daytime_within_city", "lograte_within_city")


def targets(df: DataFrame, by: str, *, count: str, rate: str, daytime: str, cap: float | None = None) -> DataFrame:
    """``df`` with a column for each of MODES.

    Rates are cut at ``cap`` before logs are taken and before the within-city modes standardise them by the mean and sample deviation of
    all the city's rows that have one, so targets are made before rows are dropped. Null rates stay null; a city without spread has null.
    """
    cut = lambda c: winsor(F.col(c).cast("double"), cap) if cap is not None else F.col(c).cast("double")
    out = df.withColumns({"rate": cut(rate), "rate_daytime": cut(daytime), "logcount": F.log1p(F.col(count).cast("double"))})
    out = out.withColumn("lograte", F.log1p("rate"))
    plain = ("rate", "rate_daytime", "lograte")
    moments = out.groupBy(by).agg(*[f(c).alias(f"_{n}_{c}") for c in plain for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = join_keyed(out, moments, [by])
    zed = lambda c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0)))
    return joined.withColumns({f"{c}_within_city": zed(c) for c in plain}).drop(*moments.columns[1:])
