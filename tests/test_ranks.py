"""Ranks, quantiles and running sums over counted values, held against pandas and numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from arealens.operators import joins, ranks

SCHEMA = "g string, id long, x double, n int, _share string"


def made(seed=0, rows=600):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        g = "hot" if rng.random() < 0.4 else [None, "a", "b", "lone"][rng.integers(0, 3)]
        x = None if rng.random() < 0.1 else float(rng.choice([0.0, -0.0, round(rng.normal(), 1), rng.lognormal(0, 3)]))
        out.append((g, i, x, int(rng.integers(0, 4)), "kept"))
    return [*out, ("lone", rows, 5.0, 1, "kept"), ("void", rows + 1, None, 2, "kept")]


@pytest.mark.parametrize("narrow", [False, True], ids=["broadcast", "shuffled"])
def test_mean_ranks_equal_pandas(spark, monkeypatch, narrow):
    if narrow:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HEAVY", 0.05)
    rows = made()
    got = ranks.mean_ranks(spark.createDataFrame(rows, SCHEMA).drop("_share"), ["g"], {"x": "rx", "n": "n"}).collect()
    frame = pd.DataFrame(rows, columns=["g", "id", "x", "n", "s"])
    grouped = frame.groupby("g", dropna=False)
    want = {i: (x, n) for i, x, n in zip(frame["id"], grouped["x"].rank(pct=True), grouped["n"].rank(pct=True), strict=True)}
    assert len(got) == len(rows)
    for r in got:
        x, n = want[r["id"]]
        assert (r["rx"] is None) == math.isnan(x) and (r["rx"] is None or r["rx"] == pytest.approx(x)) and r["n"] == pytest.approx(n)


@pytest.mark.parametrize("narrow", [False, True], ids=["broadcast", "shuffled"])
def test_quantiles_equal_numpy(spark, monkeypatch, narrow):
    if narrow:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    rows, shares = made(1), [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["column"]): (r["n"], r["q"]) for r in ranks.quantiles(spark.createDataFrame(rows, SCHEMA), ["g"], ["x", "n"], shares).collect()}
    want = {}
    for name, at in (("x", 2), ("n", 3)):
        for g in {r[0] for r in rows}:
            own = [r[at] for r in rows if r[0] == g and r[at] is not None]
            if own:
                want[g, name] = (len(own), np.quantile(own, shares))
    assert got.keys() == want.keys()
    for k, (n, q) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(q.tolist())


def test_without_groups_rows_or_values(spark):
    df = spark.createDataFrame(made(2, 50), SCHEMA)
    own = [r[2] for r in made(2, 50) if r[2] is not None]
    assert ranks.medians(df, [], "x", "m").first()["m"] == pytest.approx(np.median(own))
    assert ranks.medians(df.limit(0), ["g"], "x", "m").count() == 0
    assert ranks.mean_ranks(df.where("g = 'void'"), ["g"], {"x": "r"}).first()["r"] is None


def test_no_task_holds_a_whole_group(spark):
    """A group of distinct values is spread over its chunks by about equal numbers, however skewed the values are."""
    df = spark.range(20_000).selectExpr("1 as g", "exp(pmod(id * 7919, 20000) / 500.0) as x")
    held = ranks.counted_values(df, ["g"], ["x"])
    assert held.count() == 20_000 and held.selectExpr("max(_before + _k)").first()[0] == 20_000
    cuts = df.selectExpr("percentile_approx(x, array(0.25, 0.5, 0.75), 1280) as c").first()["c"]
    assert [round(500 * math.log(c), -2) for c in cuts] == [5000, 10000, 15000]


@pytest.mark.parametrize("limit", [0, 10**9])
@pytest.mark.parametrize("weight", [None, "w"])
def test_joins_of_null_and_frequent_keys(spark, monkeypatch, limit, weight):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(joins, "HEAVY", 0.3)
    large = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [None] * 40 + [3] * 9 + [4])], "k long, i int")
    small = spark.createDataFrame([(1, 50, "a"), (None, 40, "b"), (3, 9, "c"), (9, 0, "d")], "k long, w long, v string")
    got = joins.join_keyed(large, small, ["k"], "left", weight)
    assert "w" in got.columns or weight
    assert sorted((r["i"], r["v"]) for r in got.collect()) == [(i, "a" if i < 50 else "b" if i < 90 else "c" if i < 99 else None) for i in range(100)]
    assert joins.join_keyed(large, small, ["k"], "inner", weight).count() == 99
