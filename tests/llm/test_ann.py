"""Nearest neighbours where chunks are repeated, vectors tie, and tables are tiny or empty."""

import numpy as np
import pytest

from arealens.llm import ann

SCHEMA = "vec_id long, embedding array<double>, leaf string"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 60)
    monkeypatch.setattr(ann, "VISITS", 7)


def test_full_recall_equals_brute_force(spark, small_blocks):
    made = np.random.default_rng(5).normal(size=(700, 6)).round(1)
    made[200:420] = made[200]  # one vector many times over
    rows = [(i, v.tolist(), "x") for i, v in enumerate(made)] + [(1000, None, "x"), (1020, [0.0] * 6, "x"), (1040, [float("nan")] * 6, "x")]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), recall=1.0).toPandas()
    assert sorted(got["query_id"].unique()) == list(range(0, 700, 20))
    exact = 0
    for q, found in got.sort_values("rank").groupby("query_id"):
        scores = ann._scores(made[[q]], made)[0]
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-scores[i], i))[:20]
        exact += found["vec_id"].tolist() == want
        assert found["rank"].tolist() == list(range(1, 21))
        assert found["score"].tolist() == [scores[i] for i in found["vec_id"]]
    assert exact == 35  # every query is one of the calibration's


def test_fewer_candidates_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "a"), (20, [0.5, 0.5], "b"), (3, [2.0, 1.0], "c")], SCHEMA)
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest_neighbours(few).collect()}
    assert got == {(0, 1): 3, (0, 2): 20, (20, 1): 3, (20, 2): 0}
    assert ann.nearest_neighbours(few.where("vec_id = 3")).count() == 0
    assert ann.nearest_neighbours(few.limit(0)).count() == 0
