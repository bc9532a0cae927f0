"""Boosted regression trees, one model for each held-out fold, grown for all folds at once from counts in bins.

Predictors are cut into bins at exact quantiles. A level of a tree is one scan: every task sums residuals of its rows by fold, node, predictor
and bin, and the split of a node is the best prefix of bins in the added sums. A row carries one running prediction for each fold that it
trains, so folds are few (cities, agencies); nothing is drawn at random, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealens.operators.joins import join_keyed
from arealens.operators.ranks import quantiles
from arealens.operators.selection import TIES, DropRule, compare_sets, score_sets
from arealens.scratch import discard, stage


@dataclass(frozen=True)
class TreeParams:
    trees: int = 50
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    least: int = 20  # rows that a side of a split has at least
    shrink: float = 1.0  # added to a leaf's number of rows


@dataclass(frozen=True)
class Boosted:
    rows: DataFrame  # complete rows with y_pred by the model that has not seen their fold
    gains: DataFrame  # (_fold, predictor, gain): what a predictor's splits added in a fold's model


def _route(bins: np.ndarray, splits: dict[int, tuple[int, int]], depth: int) -> np.ndarray:
    """Nodes (1 is the root, 2n and 2n + 1 the sides of n) that rows are in after the splits (predictor, last bin on the left) so far."""
    node = np.ones(len(bins), np.int64)
    for _ in range(depth):
        for n, (j, cut) in splits.items():
            here = node == n
            node[here] = 2 * n + (bins[here, j] > cut)
    return node


def boosted_folds(df: DataFrame, columns: Sequence[str], target: str, by: str, params: TreeParams = TreeParams(), keep: Sequence[str] = ()) -> Boosted:
    """One model of boosted trees for each value of ``by``, grown on the other values' rows, over rows complete in all columns.

    A model starts at the mean of its rows; each tree takes residuals' means (n + shrink for n) of its leaves at ``rate``. A node is split where
    the sum over its sides of s^2 / (n + shrink) is largest, if that is more than its own; of equal splits the first predictor and the lowest bin
    is taken. A fold without other rows has no predictions. Bins come from all rows' predictors, targets only from fitted rows.
    """
    names = list(dict.fromkeys([by, *keep, target, *columns]))
    doubles = {c: F.col(c).cast("double") for c in [*columns, target]}
    rows = stage(df.select(*names).withColumns(doubles).dropna(subset=[by, target, *columns]), "tree_rows")
    cuts = {r["column"]: sorted(set(r["q"])) for r in quantiles(rows, [], columns, [i / params.bins for i in range(1, params.bins)]).collect()}  # bins a column
    folds = rows.groupBy(by).agg(F.count("*").alias("_n"), F.sum(target).alias("_s"))
    total = folds.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
    numbered = stage(folds.select(by, (F.row_number().over(Window.orderBy(by)) - 1).alias("_f"), F.try_divide(F.lit(total["s"]) - F.col("_s"), F.lit(total["n"]) - F.col("_n")).alias("_base")), "folds")  # one row a fold
    base = [r["_base"] for r in numbered.orderBy("_f").collect()]
    size, width, bins = len(base), len(columns), params.bins
    start = F.array(*[F.lit(float(b or 0.0)) for b in base]) if base else F.array().cast("array<double>")
    below = lambda c: F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts.get(c, [])]).cast("array<double>"), lambda x: x < F.col(c)))
    place = F.array(*map(below, columns))
    state = stage(join_keyed(rows, numbered.drop("_base"), [by]).withColumns({"_bins": place, "_score": start}), "boosting")
    spark, gained = df.sparkSession, []
    schema = state.select("_f", F.col(target).alias("_y"), "_bins", "_score")

    for _ in range(params.trees):
        splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(size)]
        for level in range(params.depth):
            low = 1 << level

            def sums(batches: Iterator[pd.DataFrame], splits=splits, level=level, low=low) -> Iterator[pd.DataFrame]:
                cells = low * width * bins
                n, s = np.zeros((size, cells)), np.zeros((size, cells))
                for b in batches:
                    fold, y = b["_f"].to_numpy(), b["_y"].to_numpy(float)
                    x, score = np.stack(b["_bins"].to_list()).astype(np.int64) if len(b) else np.zeros((0, width), np.int64), np.stack(b["_score"].to_list()) if len(b) else np.zeros((0, size))
                    for f in range(size):
                        node = _route(x, splits[f], level) - low
                        mine = np.flatnonzero((fold != f) & (node >= 0))
                        rest = y[mine] - score[mine, f]
                        for j in range(width):
                            at = (node[mine] * width + j) * bins + x[mine, j]
                            n[f] += np.bincount(at, minlength=cells)
                            s[f] += np.bincount(at, rest, cells)
                f, at = np.nonzero(n)
                yield pd.DataFrame({"f": f, "node": low + at // (width * bins), "j": at // bins % width, "bin": at % bins, "n": n[f, at], "s": s[f, at]})

            counted = schema.mapInPandas(sums, "f int, node int, j int, bin int, n double, s double").groupBy("f", "node", "j", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            run = Window.partitionBy("f", "node", "j").orderBy("bin")
            whole = Window.partitionBy("f", "node", "j")
            left = counted.select("f", "node", "j", "bin", F.sum("n").over(run).alias("n"), F.sum("s").over(run).alias("s"), F.sum("n").over(whole).alias("_n"), F.sum("s").over(whole).alias("_s"))
            worth = lambda s, n: s * s / (n + F.lit(params.shrink))
            gain = worth(F.col("s"), F.col("n")) + worth(F.col("_s") - F.col("s"), F.col("_n") - F.col("n")) - worth(F.col("_s"), F.col("_n"))
            able = left.withColumn("gain", F.round(gain, 9)).where((F.col("n") >= params.least) & (F.col("_n") - F.col("n") >= params.least) & (F.col("gain") > 0))
            best = able.groupBy("f", "node").agg(F.max(F.struct("gain", (-F.col("j")).alias("j"), (-F.col("bin")).alias("bin"))).alias("b"))
            for r in best.select("f", "node", "b.*").collect():  # a row for each fold and node of the level
                splits[r["f"]][r["node"]] = (-r["j"], -r["bin"])
                gained.append((r["f"], columns[-r["j"]], r["gain"]))
        leaves = _leaf_values(schema, splits, params, size)

        def moved(batches: Iterator[pd.DataFrame], splits=splits, leaves=leaves) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x, score = np.stack(b["_bins"].to_list()).astype(np.int64), np.stack(b["_score"].to_list())
                    for f in range(size):
                        node = _route(x, splits[f], params.depth)
                        score[:, f] += params.rate * np.array([leaves.get((f, k), 0.0) for k in range(2 << params.depth)])[node]
                    yield b.assign(_score=list(score))

        before, state = state, stage(state.mapInPandas(moved, state.schema), "boosting")
        discard(before)
        schema = state.select("_f", F.col(target).alias("_y"), "_bins", "_score")
    own = F.when(F.lit(size > 1), F.get("_score", F.col("_f")))
    fold_names = numbered.select("_f", F.col(by).alias("_fold"))
    kinds = "_f int, predictor string, gain double"
    gains = spark.createDataFrame(gained, kinds).groupBy("_f", "predictor").agg(F.sum("gain").alias("gain"))
    return Boosted(state.withColumn("y_pred", own).where("y_pred is not null").drop("_f", "_bins", "_score"), gains.join(F.broadcast(fold_names), "_f").select("_fold", "predictor", "gain"))


def _leaf_values(schema: DataFrame, splits: list[dict[int, tuple[int, int]]], params: TreeParams, size: int) -> dict[tuple[int, int], float]:
    """Mean residual, shrunk, of each fold's leaves; a leaf is where a row's way down the splits ends."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = 2 << params.depth
        n, s = np.zeros((size, cells)), np.zeros((size, cells))
        for b in batches:
            if len(b):
                fold, y, x, score = b["_f"].to_numpy(), b["_y"].to_numpy(float), np.stack(b["_bins"].to_list()).astype(np.int64), np.stack(b["_score"].to_list())
                for f in range(size):
                    node, mine = _route(x, splits[f], params.depth), fold != f
                    n[f] += np.bincount(node[mine], minlength=cells)
                    s[f] += np.bincount(node[mine], y[mine] - score[mine, f], cells)
        f, at = np.nonzero(n)
        yield pd.DataFrame({"f": f, "node": at, "n": n[f, at], "s": s[f, at]})

    found = schema.mapInPandas(sums, "f int, node int, n double, s double").groupBy("f", "node").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return {(r["f"], r["node"]): r["s"] / (r["n"] + params.shrink) for r in found}


def gain_shares(boosted: Boosted) -> DataFrame:
    """(predictor, share): each predictor's part of all gains, averaged over folds before parts are taken."""
    folds = boosted.gains.select("_fold").distinct().count()
    mean = boosted.gains.groupBy("predictor").agg((F.sum("gain") / F.lit(float(max(folds, 1)))).alias("_g"))
    return mean.crossJoin(F.broadcast(mean.agg(F.sum("_g").alias("_t")))).select("predictor", F.try_divide("_g", "_t").alias("share"))  # one row


def _both(df: DataFrame, key: str, sets: Sequence[Sequence[str]], target: str, by: str, params: Sequence[TreeParams]) -> DataFrame:
    """Rows complete in every column of ``sets`` with p0, p1, ...: predictions of one model for each set and its params."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    rows = stage(df.select(by, key, target, *every).dropna(), "common_rows")
    out = rows.select(by, key, F.col(target).cast("double").alias(target))
    for k, (s, p) in enumerate(zip(sets, params, strict=True)):
        found = boosted_folds(rows, s, target, by, p, keep=[key]).rows
        out = out.join(found.select(key, F.col("y_pred").alias(f"p{k}")), key)
    return stage(out, "runs")


def confirm(df: DataFrame, full: Sequence[str], reduced: Sequence[str], target: str, by: str, key: str, *, fixed: Sequence[str] = (), rule: DropRule = DropRule(), params: TreeParams = TreeParams()) -> dict[str, float | bool | None]:
    """Whether trees also do as well with ``fixed`` and ``reduced`` columns as with ``full``: r2 of both, change, share of cities not worse, and ``adopt``."""
    rows = _both(df, key, [[*fixed, *full], [*fixed, *reduced]], target, by, [params, params])
    found = score_sets(rows, by, target, 2, rule.net)
    ((change, own, _),) = compare_sets(found, rule.mean)
    r2 = found.pooled_r2 if rule.mean == "pooled" else found.mean_r2
    return {"r2_full": r2[0], "r2_reduced": r2[1], "d_r2": change, "share_not_worse": own, "adopt": rule.allows(change, own)}


def tune(df: DataFrame, columns: Sequence[str], target: str, by: str, key: str, grid: Sequence[TreeParams], *, default: TreeParams = TreeParams(), net: float = 0.1) -> tuple[TreeParams, list[tuple[TreeParams, float | None, float | None, bool]]]:
    """The params of ``grid`` with the highest city-mean r2 among those whose city-mean recall is not below the default's; the default if none beats it.

    Also every trial with its r2, recall and whether it was feasible, the default first.
    """
    tried = [default, *grid]
    rows = _both(df, key, [list(columns)] * len(tried), target, by, tried)
    found = score_sets(rows, by, target, len(tried), net)
    r2, recall = found.mean_r2, found.mean_recall
    trials = [(p, r2[k], recall[k], recall[k] is not None and recall[0] is not None and recall[k] >= recall[0] - TIES) for k, p in enumerate(tried)]
    best = max((t for t in trials if t[3] and t[1] is not None), key=lambda t: t[1], default=trials[0])
    return best[0], trials
