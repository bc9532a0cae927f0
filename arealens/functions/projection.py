"""Map projections as column expressions on an ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS 80 ellipsoid and the standard parallels and origin of the equal-area plane for the contiguous states.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0}

E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (E * math.sin(lat)) ** 2)


def _q(lat: float) -> float:
    s = math.sin(lat)
    return (1 - E * E) * (s / (1 - (E * s) ** 2) - math.log((1 - E * s) / (1 + E * s)) / (2 * E))


def _t(lat: float) -> float:
    s = E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (E / 2)


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north in the equal-area conic ALBERS of degrees; null if either is."""
    one, two, zero = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (_m(one) ** 2 - _m(two) ** 2) / (_q(two) - _q(one))
    c = _m(one) ** 2 + n * _q(one)
    s = F.sin(F.radians(lat))
    q = (1 - E * E) * (s / (1 - F.pow(E * s, F.lit(2))) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))
    rho, theta = SEMI_MAJOR / n * F.sqrt(c - n * q), F.radians(lon - ALBERS["lon0"]) * n
    return rho * F.sin(theta), SEMI_MAJOR / n * math.sqrt(c - n * _q(zero)) - rho * F.cos(theta)


def lambert_constants(lat1: float, lat2: float, lat0: float) -> tuple[float, float, float]:
    """(n, a * F, radius at the origin) of a conformal conic with two standard parallels in degrees."""
    one, two, zero = (math.radians(v) for v in (lat1, lat2, lat0))
    n = (math.log(_m(one)) - math.log(_m(two))) / (math.log(_t(one)) - math.log(_t(two)))
    f = SEMI_MAJOR * _m(one) / (n * _t(one) ** n)
    return n, f, f * _t(zero) ** n


def lambert_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, steps: int = 5) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of metres in a conformal conic (n > 0); ``steps`` fixed-point steps settle beyond 1e-12."""
    n, f, rho0 = lambert_constants(lat1, lat2, lat0)
    t = F.pow(F.sqrt(x * x + F.pow(rho0 - y, F.lit(2))) / f, F.lit(1 / n))
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(steps):
        s = E * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(E / 2)))
    return F.degrees(F.atan2(x, rho0 - y) / n) + lon0, F.degrees(lat)
