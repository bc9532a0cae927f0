"""Nearest targets of odd points, the conic's inverse against its own forward formulas, and clipped lengths in a concave ring."""

import math

import pytest
from pyspark.sql import functions as F

from arealens.functions import projection as P
from arealens.operators import overlay, spatial


def test_every_point_has_a_row(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 900.0, 900.0)], "id long, x double, y double")
    targets = spark.createDataFrame([(7, 0.0, 1.0), (6, 1.0, 0.0), (8, None, None)], "id long, x double, y double")
    got = {r["id"]: (r["target"], r["dist"]) for r in spatial.nearest(points, targets, 1.0, rounds=3).collect()}
    assert got == {1: (6, 1.0), 2: (None, math.inf), 3: (None, math.inf)}
    assert {r["target"] for r in spatial.nearest(points, targets.limit(0), 1.0).collect()} == {None}


def test_conic_round_trip(spark):
    plane = {"lat1": 33.0, "lat2": 45.0, "lat0": 23.0, "lon0": -96.0}
    n, f, rho0 = P.lambert_constants(plane["lat1"], plane["lat2"], plane["lat0"])
    places = [(-75.0, 35.0), (-100.0, 48.5), (-96.0, 23.0)]
    rows = []
    for lon, lat in places:
        rho, theta = f * P._t(math.radians(lat)) ** n, n * math.radians(lon - plane["lon0"])
        rows.append((lon, lat, rho * math.sin(theta), rho0 - rho * math.cos(theta)))
    lon, lat = P.lambert_inverse(F.col("x"), F.col("y"), **plane)
    for r in spark.createDataFrame(rows, "lon double, lat double, x double, y double").select("*", lon.alias("a"), lat.alias("b")).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)


def test_concave_ring(spark):
    # A "U": the line through both arms lies in it for two of its four units.
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([(1, ring)], "polygon long, ring array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([(1, -1.0, 2.0, 5.0, 2.0), (2, 1.5, 2.0, 2.5, 2.0), (3, 0.2, 0.5, 0.8, 0.5), (4, None, 1.0, 2.0, 2.0)], "segment long, x0 double, y0 double, x1 double, y1 double")
    got = {r["segment"]: r["inside"] for r in overlay.segments_over_polygons(lines, polygons, 2.0).collect()}
    assert got == pytest.approx({1: 2.0, 3: 0.6})
    m = polygons.select(overlay.ring_measures(F.col("ring")).alias("m")).first()["m"]
    assert (m["area"], m["cx"], m["length"]) == pytest.approx((8.0, 2.0, 18.0))
