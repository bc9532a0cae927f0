"""Contributions, shuffled and dropped predictors, levels, coefficients and spatial tests where queries have no such rows."""

import math

import numpy as np
import pandas as pd
import pytest

from arealens.operators import attribution, crossval, inference, levels
from test_selection import predicted, table


def test_contributions_add_up_and_families_rank(spark):
    frame = table(0, 5, 60)
    df = spark.createDataFrame(frame)
    pool = crossval.pool_of(df, ["x1", "x2", "anchor"], "y", "city", keep=["id"])
    fits = crossval.fold_fits(pool, [["x1", "x2", "anchor"]])
    rows = attribution.contributions(pool, fits).toPandas().sort_values("id")
    assert rows["y_pred"].to_numpy() == pytest.approx(predicted(frame, ["x1", "x2", "anchor"]), abs=1e-8)
    assert (rows["base"] + rows["c_x1"] + rows["c_x2"] + rows["c_anchor"]).to_numpy() == pytest.approx(rows["y_pred"].to_numpy())
    assert rows["base"].to_numpy() == pytest.approx([frame.loc[frame["city"] != c, "y"].mean() for c in rows["city"]])
    costs = {r["predictor"]: r["drop"] for r in attribution.shuffled_costs(pool, fits, "id").collect()}
    assert costs["anchor"] is None and costs["x1"] > costs["x2"] > 0.05


def test_dropout_scores_the_same_rows_and_ranks_signal_first(spark):
    frame = table(1, 5, 60).rename(columns={"x1": "transit", "x2": "road"})
    frame.loc[frame.index % 17 == 0, "x3"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "city string, id long, transit double, road double, x3 double, twin double, sparse double, cityish double, anchor double, y double")
    deltas, by_city = attribution.family_dropout(df, ["transit", "road", "x3"], {"transit": ["transit"], "road": ["road"]}, "y", "city", "id", seeds=(0, 1))
    rows = {r["family"]: r for r in deltas.collect()}
    assert set(rows) == {"transit", "road", "other"} and rows["transit"]["d_r2"] > 0.2 and rows["transit"]["d_r2"] > rows["road"]["d_r2"] > rows["other"]["d_r2"]
    assert rows["transit"]["cities_helped"] == 5 and rows["transit"]["sd_r2"] >= 0 and by_city.count() == 15


def stats_of(n, seed=0):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"city": range(n), "obs_rate": rng.integers(1, 5, n) * 1.0, "obs_log": rng.normal(2, 1, n), "pred_log": rng.normal(2, 1, n), "pred_rate": rng.lognormal(2, 1, n), "anchor": rng.integers(1, 4, n) * 2.0})
    frame.loc[frame["city"] % 5 == 4, "anchor"] = np.nan
    return frame


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 12, 23])
def test_level_targets_equal_each_city_left_out(spark, n):
    frame = stats_of(n, n)
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    ratio = {r["city"]: r["target"] for r in levels.level_targets(df, "ratio").collect()}
    line = {r["city"]: r["target"] for r in levels.level_targets(df, "loglin").collect()}
    for c, own in frame.iterrows():
        rest = frame.drop(index=c).dropna(subset=["anchor"])
        if math.isnan(own["anchor"]) or rest.empty:
            assert ratio[c] is None and line[c] is None
            continue
        assert ratio[c] == pytest.approx(own["anchor"] * (rest["obs_rate"] / rest["anchor"]).median())
        if rest["anchor"].nunique() > 1:
            b, a = np.polyfit(np.log1p(rest["anchor"]), rest["obs_log"], 1)
            assert line[c] == pytest.approx(a + b * np.log1p(own["anchor"]))
        else:
            assert line[c] is None


def test_runs_are_moved_by_factor_or_shift(spark):
    run = spark.createDataFrame([(c, i, 1.0 + i, 0.5 + i / 3, 2.0) for c in range(4) for i in range(5)], "city long, id long, y double, p double, w double")
    anchors = spark.createDataFrame([(0, 3.0), (1, 5.0), (2, 9.0)], "city long, anchor double")
    stats = levels.city_levels(run, anchors)
    naive = levels.relevel_run(run, stats, "naive").groupBy("city").agg({"p": "count"}).count()
    moved = {(r["city"], r["id"]): r["p"] for r in levels.relevel_run(run, stats, "naive").collect()}
    assert naive == 4 and moved[3, 2] == pytest.approx(0.5 + 2 / 3)  # no anchor: stays
    assert np.mean([math.expm1(moved[1, i]) for i in range(5)]) == pytest.approx(5.0)
    half = {(r["city"], r["id"]): r["p"] for r in levels.relevel_run(run, stats, "oracle", 0.5).collect()}
    assert np.mean([half[0, i] for i in range(5)]) == pytest.approx((np.mean([0.5 + i / 3 for i in range(5)]) + 3.0) / 2)
    with pytest.raises(ValueError, match="method"):
        levels.level_targets(stats, "nope")


def test_tails_and_coefficients(spark):
    assert inference.student_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert inference.student_tail(0.0, 3) == 1 and inference.student_tail(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert inference.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    frame = table(0, 3, 30)
    frame["flat"] = 1.0
    found, fit = inference.ols_hc3(spark.createDataFrame(frame), ["x1", "flat", "x3"], "y")
    rows = {r["term"]: r for r in found.collect()}
    z = (frame[["x1", "x3"]] - frame[["x1", "x3"]].mean()) / frame[["x1", "x3"]].std(ddof=0)
    x, y = np.c_[np.ones(len(frame)), z], frame["y"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e, h = y - x @ b, np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = np.sqrt(np.diag(inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv))
    for i, t in enumerate(("const", "x1", "x3")):
        assert (rows[t]["coef"], rows[t]["se"], rows[t]["se_hc3"]) == pytest.approx((b[i], math.sqrt(e @ e / (len(y) - 3) * inv[i, i]), hc3[i]))
    assert rows["flat"]["coef"] == 0 and rows["flat"]["se"] is None and rows["x1"]["stars"] == "***"
    assert fit["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum()) and fit["p_f"] < 1e-6
    assert inference.ols_hc3(spark.createDataFrame(frame).limit(2), ["x1", "x3"], "y")[0].where("coef is null").count() == 3


def test_spatial_tests_of_islands_nulls_and_constants(spark):
    units = spark.createDataFrame([(i, "a" if i < 12 else "b", float(i % 3) if i < 12 else 1.0) for i in range(16)] + [(16, "a", None), (17, "lone", 4.0)], "id long, g string, v double")
    edges = spark.createDataFrame([(i, (i + d) % 12) for i in range(11) for d in (3, 9)] + [(12, 13), (13, 12), (0, 16), (16, 0)], "src long, dst long")
    rows = {r["id"]: r for r in inference.local_moran(units, edges, "v", "g", draws=49, alpha=0.2).collect()}
    assert len(rows) == 18 and rows[11]["i"] is None and rows[16]["label"] == rows[17]["label"] == "Not sig."
    assert rows[0]["i"] > 0 and rows[0]["p"] < 0.2 and rows[0]["label"] == "LL" and rows[2]["label"] == "HH"
    assert rows[12]["i"] == 0 and rows[12]["label"] == "Not sig."
    whole = {r["g"]: r for r in inference.morans_i(units, edges, "v", "g", draws=49).collect()}
    assert whole["a"]["i"] == pytest.approx(7 / 8 * 12 / 11) and whole["a"]["p"] == 0.02 and whole["b"]["i"] is None and whole["lone"]["p"] is None
    assert inference.local_moran(units.limit(0), edges, "v", "g").count() == 0
