"""Boosted trees over folds against a plain loop, and what is built on them."""

import numpy as np
import pandas as pd
import pytest

from arealens.operators import selection, trees
from test_selection import table

P = trees.TreeParams(trees=2, depth=2, rate=0.5, bins=6, least=10)


def plain(frame, columns, p):
    """Predictions and gains of each held-out city, tree by tree and node by node."""
    x, y, city = frame[columns].to_numpy(float), frame["y"].to_numpy(), frame["city"].to_numpy()
    cuts = [sorted(set(np.quantile(x[:, j], [i / p.bins for i in range(1, p.bins)]))) for j in range(len(columns))]
    b = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(len(columns))], axis=1)
    out, gains = np.zeros(len(y)), {}
    for c in sorted(set(city)):
        fit = city != c
        score = np.full(len(y), y[fit].mean())
        for _ in range(p.trees):
            rest = y - score
            add = np.zeros(len(y))

            def grow(rows, depth):
                mine = rows & fit
                n, s = mine.sum(), rest[mine].sum()
                best = None
                for j in range(len(columns)):
                    for cut in range(p.bins):
                        left = mine & (b[:, j] <= cut)
                        k, t = left.sum(), rest[left].sum()
                        if depth < p.depth and k >= p.least and n - k >= p.least and cut in set(b[mine, j]):
                            gain = round(t * t / (k + p.shrink) + (s - t) ** 2 / (n - k + p.shrink) - s * s / (n + p.shrink), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, j, cut)
                if best is None:
                    add[rows] = s / (n + p.shrink) if n else 0
                    return
                gains[c, columns[best[1]]] = gains.get((c, columns[best[1]]), 0) + best[0]
                grow(rows & (b[:, best[1]] <= best[2]), depth + 1)
                grow(rows & (b[:, best[1]] > best[2]), depth + 1)

            grow(np.ones(len(y), bool), 0)
            score = score + p.rate * add
        out[city == c] = score[city == c]
    return out, gains


def test_predictions_and_gains_equal_a_plain_loop(spark):
    frame = table(2, 4, 50)
    frame.loc[3, "x2"] = np.nan
    df = spark.createDataFrame(frame)
    got = trees.boosted_folds(df.replace(float("nan"), None), ["x1", "x2", "sparse"], "y", "city", P, keep=["id"])
    frame = frame.dropna().reset_index(drop=True)
    want, gains = plain(frame, ["x1", "x2", "sparse"], P)
    assert got.rows.toPandas().sort_values("id")["y_pred"].to_numpy() == pytest.approx(want[np.argsort(frame["id"])], abs=1e-8)
    assert {(r["_fold"], r["predictor"]): r["gain"] for r in got.gains.collect()} == pytest.approx(gains)
    shares = {r["predictor"]: r["share"] for r in trees.gain_shares(got).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["x1"] == max(shares.values())


def test_confirm_and_tune(spark):
    df = spark.createDataFrame(table(0, 4, 60))
    drop_noise = trees.confirm(df, ["x1", "x3"], ["x1"], "y", "city", "id", fixed=["anchor"], params=P, rule=selection.DropRule(0.05, 0.0))
    assert drop_noise["adopt"] and not trees.confirm(df, ["x1", "x2"], ["x2"], "y", "city", "id", params=P)["adopt"]
    best, trials = trees.tune(df, ["x1", "x2"], "y", "city", "id", [trees.TreeParams(trees=4, depth=2, rate=0.5, bins=6, least=10), trees.TreeParams(trees=1, depth=1, rate=0.01)], default=P)
    feasible = [t for t in trials if t[3]]
    assert best == max(feasible, key=lambda t: t[1])[0] and trials[0][0] == P and trials[0][3]


def test_few_rows(spark):
    df = spark.createDataFrame(table(0, 2, 5))
    assert trees.boosted_folds(df.limit(0), ["x1"], "y", "city", P).rows.count() == 0
    assert trees.boosted_folds(df.where("city = 'c0'"), ["x1"], "y", "city", P).rows.count() == 0  # no other city to learn from
    small = trees.boosted_folds(df, ["x1"], "y", "city", P).rows.toPandas()  # too few rows to split: the other city's shrunk mean
    means = table(0, 2, 5).groupby("city")["y"].mean()
    assert small.groupby("city")["y_pred"].mean().to_dict() == pytest.approx({"c0": means["c1"], "c1": means["c0"]})
    assert isinstance(small, pd.DataFrame)
