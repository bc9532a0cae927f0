"""Levels of held-out cities: what each should be by the others, and predictions moved to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealens.operators.joins import join_keyed
from arealens.operators.ranks import counted_values
from arealens.scratch import stage

METHODS = ("naive", "ratio", "loglin", "oracle")


def city_levels(run: DataFrame, anchors: DataFrame, weight: str = "w") -> DataFrame:
    """(city, obs_rate, obs_log, pred_log, pred_rate, anchor) of a run (city, y, p, weight) whose y and p are logs of 1 + rate.

    Rates are means weighted by ``weight``, logs plain means. ``anchors`` has (city, anchor), a rate; cities without one have null.
    """
    mean = lambda c: F.try_divide(F.sum(F.expm1(c) * F.col(weight)), F.sum(weight))
    stats = run.groupBy("city").agg(mean("y").alias("obs_rate"), F.avg("y").alias("obs_log"), F.avg("p").alias("pred_log"), mean("p").alias("pred_rate"))
    return join_keyed(stats, anchors.select("city", "anchor"), ["city"], "left")


def level_targets(stats: DataFrame, method: str) -> DataFrame:
    """(city, target) for each city of ``city_levels``: a rate for naive and ratio, a mean log rate for loglin and oracle.

    naive is the anchor; ratio the anchor times the median, over the other cities, of observed rate by anchor; loglin the line of observed log on log
    anchor, fitted on the other cities, at the own anchor; oracle the own observed log. Medians and lines of the others come from places and
    sums of all, less the own; cities are never paired. Null where there is no anchor, or fewer than one (loglin: two different) others have one.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method in ("naive", "oracle"):
        return stats.select("city", F.col("anchor" if method == "naive" else "obs_log").alias("target"))
    if method == "ratio":
        rated = stats.withColumn("_r", F.try_divide("obs_rate", "anchor"))
        counted = counted_values(rated, [], ["_r"])
        others = F.col("_n") - 1
        places = {"lo": F.floor((others - 1) / 2), "hi": F.floor(others / 2)}
        at = lambda q: F.max(F.when((F.col("_before") <= q) & (q < F.col("_before") + F.col("_k")), F.col("_value")))
        middle = counted.agg(*[at(q + k).alias(f"{n}{k}") for n, q in places.items() for k in (0, 1)], *[F.max(q).alias(n) for n, q in places.items()])
        own = counted.select(F.col("_value").alias("_r"), F.col("_before").alias("_place"))
        ranked = join_keyed(rated, own, ["_r"], "left").crossJoin(F.broadcast(middle))  # one row
        # Without the own value, places from it on hold the value that was one further; a city without a ratio takes nothing out.
        pick = lambda n: F.when(F.col(n) < F.col("_place"), F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
        return ranked.select("city", F.when(F.col("_r").isNotNull(), F.col("anchor") * (pick("lo") + pick("hi")) / 2).alias("target"))
    x, y = F.when(F.col("obs_log").isNotNull(), F.log1p("anchor")), F.when(F.col("anchor").isNotNull(), F.col("obs_log"))
    terms = {"n": F.when(x.isNotNull() & y.isNotNull(), 1.0), "x": x, "y": y, "xx": x * x, "xy": x * y}
    total = stats.agg(*[F.sum(c).alias(f"_t{k}") for k, c in terms.items()])
    rest = stats.crossJoin(F.broadcast(total)).withColumns({f"_{k}": F.col(f"_t{k}") - F.coalesce(c, F.lit(0.0)) for k, c in terms.items()})  # one row
    slope = F.try_divide(F.expr("_n * _xy - _x * _y"), F.expr("CASE WHEN _n * _xx - _x * _x > 1e-12 * _n * _xx THEN _n * _xx - _x * _x END"))
    return rest.select("city", (F.try_divide(F.col("_y"), F.col("_n")) + slope * (F.log1p("anchor") - F.try_divide(F.col("_x"), F.col("_n")))).alias("target"))


def relevel_run(run: DataFrame, stats: DataFrame, method: str, weight: float = 1.0) -> DataFrame:
    """``run`` with each city's p moved by ``weight`` of the way to its target: rates by one factor, logs by one shift; cities without a finite target stay."""
    joined = stage(level_targets(stats, method), "targets")
    moved = join_keyed(run, join_keyed(stats, joined, ["city"]).select("city", F.col("pred_log").alias("_log"), F.col("pred_rate").alias("_rate"), F.col("target").alias("_target")), ["city"], "left")
    p = F.col("p")
    new: Column = F.log1p(F.expm1(p) * F.try_divide("_target", "_rate")) if method in ("naive", "ratio") else p + F.col("_target") - F.col("_log")
    change = F.coalesce(F.when(~F.isnan(new) & (F.abs(new) < float("inf")), new - p), F.lit(0.0))
    return moved.withColumn("p", p + F.lit(weight) * change).select(*run.columns)
