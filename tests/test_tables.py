"""Sources and reports on small and odd inputs."""

import pytest

from arealens.operators import reports
from arealens.sources import tables


def test_names_are_cleaned_and_clashes_raise(spark):
    assert [tables.clean_name(x) for x in ("Case #", " Long Name ", "a--b")] == ["case_num", "long_name", "a_b"]
    with pytest.raises(ValueError):
        tables.clean_names(spark.createDataFrame([(1, 2)], ["a b", "A_B"]))


def test_materialize_computes_once_unless_refreshed(spark, tmp_path):
    path, one, two = str(tmp_path / "t"), lambda: spark.range(1), lambda: spark.range(2)
    counts = [tables.materialize(spark, path, one).count(), tables.materialize(spark, path, two).count(), tables.materialize(spark, path, two, refresh=True).count()]
    assert counts == [1, 1, 2]


def test_a_run_with_repeated_keys_is_refused(spark, tmp_path):
    path, pool = str(tmp_path / "runs"), spark.createDataFrame([("a",), ("b",)], ["k"])
    tables.append_run(spark.createDataFrame([("a", 1.0), ("b", 2.0)], ["k", "p"]), path, "r1", "base", 1)
    assert tables.load_run(spark, path, "base", pool, "k").count() == 2
    tables.append_run(spark.createDataFrame([("a", 1.0), ("a", 2.0)], ["k", "p"]), path, "r2", "base", 2)
    with pytest.raises(ValueError):
        tables.load_run(spark, path, "base", pool, "k")


def test_correlations_endure_nulls_constants_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    found = {(x["a"], x["b"]): x["r"] for x in reports.correlations(df, ["a", "b", "c"]).collect()}
    assert found[("a", "b")] == pytest.approx(1.0) and found[("a", "c")] is None
    assert all(x["r"] is None for x in reports.correlations(df.limit(0), ["a", "b"]).collect())
    empty = reports.describe(df.where("a < 0"), ["a"]).first()
    assert (empty["n"], empty["mean"], empty["skew"]) == (0, None, None)


def test_missing_values_come_from_the_first_level_that_has_one(spark):
    df = spark.createDataFrame([(1, "p", "m", 4.0, 1.0), (2, "p", "m", None, 1.0), (3, "q", "m", None, 3.0), (4, None, "z", None, 1.0)], "id int, zip string, metro string, v double, w double")
    got = {x["id"]: x["v"] for x in reports.fill_from_levels(df, "v", "w", ["zip", "metro"]).collect()}
    assert got == {1: 4.0, 2: 4.0, 3: 4.0, 4: None}


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (None,)], "v double")
    assert {x["bin"]: x["n"] for x in reports.histogram(df, "v", 0.0, 10.0, 2).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
