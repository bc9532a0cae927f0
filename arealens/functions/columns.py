"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def rate(count: Column, base: Column, per: float = 1000.0) -> Column:
    """``per`` times the ratio, null on a null or zero base."""
    return F.try_divide(count.cast("double"), base) * per


def row_mean(values: Sequence[Column]) -> Column:
    """Mean of those that are not null; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.try_divide(total, reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values]))


def composite(rates: Mapping[str, float], total: float) -> Column:
    """Mean over the available rates of rate / benchmark, times the total's benchmark."""
    return row_mean([F.col(c) / b for c, b in rates.items()]) * total


TRANSFORMS = {"log1p": lambda c: F.log1p(F.greatest(c, F.lit(0.0))), "sqrt": lambda c: F.sqrt(F.greatest(c, F.lit(0.0))), "identity": lambda c: c}


def transform(column: str, form: str) -> Column:
    """Model form of a column, clipped at 0 first; an unknown form raises KeyError."""
    return TRANSFORMS[form](F.col(column))


def winsor(value: Column, cap: float) -> Column:
    return F.when(value > cap, F.lit(cap)).otherwise(value)


def parse_service_time(text: Column) -> Column:
    """Seconds since service midnight of ``HH:MM:SS``, hours beyond 24 included; null if malformed."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d{1,2}):(\d{2}):(\d{2})$", i)
    return F.when(part(1) != "", part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rounded(value: str, digits: int) -> Column:
    """``round`` of a column of doubles, by compiled arithmetic where the value is not near a tie, else by ``round`` itself, which goes through decimals."""
    scaled = F.col(value) * 10.0**digits
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(F.round(value, digits))


def z_score(value: str, *by: str) -> Column:
    """Distance from the group's mean in sample standard deviations; null where they are 0 or null."""
    own = Window.partitionBy(*by)
    return F.try_divide(F.col(value) - F.avg(value).over(own), F.stddev_samp(value).over(own))


def demeaned(value: str, *by: str) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*by))
