"""Cleaning of point-event feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows whose leniently parsed date lies in [start, end); unparseable ones go."""
    when = F.col(column).try_cast("timestamp")
    return df.where((when >= F.lit(start).cast("timestamp")) & (when < F.lit(end).cast("timestamp")))


def explode_codes(df: DataFrame, column: str, delimiter: str, into: str) -> DataFrame:
    """A row for each trimmed code of a delimited cell; a null cell keeps one row with a null code."""
    return df.withColumn(into, F.explode_outer(F.transform(F.split(column, delimiter), F.trim)))


def wkt_point(text: Column) -> tuple[Column, Column]:
    """x and y of ``POINT (x y)``; null where blank or malformed."""
    part = lambda i: F.regexp_extract(text, r"^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$", i).try_cast("double")
    return part(1), part(2)


def drop_points(df: DataFrame, lat: str, lon: str, points: Sequence[tuple[float, float]], digits: int = 5) -> DataFrame:
    """Rows not at one of the sentinel points, compared after rounding; rows without coordinates stay."""
    hit = F.lit(False)
    for a, b in points:
        hit |= (F.round(F.col(lat), digits) == round(a, digits)) & (F.round(F.col(lon), digits) == round(b, digits))
    return df.where(~F.coalesce(hit, F.lit(False)))


def dedup_prefer(df: DataFrame, keys: Sequence[str], prefer: Column, order: Sequence[str]) -> DataFrame:
    """One row a key: one for which ``prefer`` holds if there is any, then the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce(prefer, F.lit(False)).desc(), *order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def map_codes(df: DataFrame, column: str, mapping: Mapping[str, str], into: str) -> DataFrame:
    """Category of each code by a fixed dictionary; an unmapped code has none."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(into, F.create_map(*pairs)[F.col(column)])


def refine(df: DataFrame, code: str, detail: str, rules: Mapping[str, str], category: str) -> DataFrame:
    """Null the category of listed codes unless ``detail`` matches the code's pattern, in any case; a null detail fails."""
    failed = F.lit(False)
    for value, pattern in rules.items():
        failed |= (F.col(code) == value) & ~F.coalesce(F.col(detail).rlike(f"(?i){pattern}"), F.lit(False))
    return df.withColumn(category, F.when(~F.coalesce(failed, F.lit(False)), F.col(category)))


def majority(df: DataFrame, key: str, area: str) -> DataFrame:
    """(key, area, n): the area with most of a key's rows, ties to the lesser area."""
    counts = df.groupBy(key, area).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(area).alias("a"))).alias("_t")).select(key, F.col("_t.a").alias(area), (-F.col("_t.m")).alias("n"))


def as_of_latest(panel: DataFrame, key: str, time: str, at: Column | int, values: Sequence[str]) -> DataFrame:
    """Per key the values of the latest time not after ``at``, with that time as ``{time}_used``."""
    at = F.lit(at) if isinstance(at, int) else at
    kept = panel.where(F.col(time) <= at).groupBy(key).agg(F.max_by(F.struct(time, *values), F.col(time)).alias("_t"))
    return kept.select(key, F.col(f"_t.{time}").alias(f"{time}_used"), *[F.col(f"_t.{v}").alias(v) for v in values])


def match_predicate(code: str, codes: Sequence, names: Sequence[str], patterns: Sequence[str]) -> Column:
    """Rows with one of ``codes`` (any, if there are none) of which some name is like some pattern in any case (any, if there are none)."""
    coded = F.col(code).isin(list(codes)) if codes else F.lit(True)
    named = [F.lower(n).like(p.lower()) for p in patterns for n in names]
    return coded & (reduce(lambda a, b: a | b, named) if named else F.lit(True))
