"""Rounding by compiled arithmetic equals round."""

import random

from pyspark.sql import functions as F

from arealens.functions import columns as C


def test_rounded_equals_round(spark):
    rng = random.Random(1)
    values = [rng.uniform(-20000, 20000) for _ in range(3000)] + [k / 10000 + d for k in range(-50, 50) for d in (0.0, 0.00005, -0.00005, 4.9e-5, 5.1e-5)] + [1e15 + 0.3, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~C.rounded("v", 4).eqNullSafe(F.round("v", 4))).isEmpty()
