"""Linear models of many predictors over folds, from one pass of products per fold.

Each fold's sums of products are one row, and a fold is fitted on the total less its own row, so no candidate set and no fold needs
another scan. A set of predictors is a sub-matrix of these sums. The only scan that a fit adds is the one that chooses a ridge penalty by
leave-one-out errors; it goes over all folds, sets and penalties at once. Rows are read in place, and fits are rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.joins import BROADCAST_BYTES, join_keyed
from arealens.scratch import stage

#: Penalties that leave-one-out errors choose from (fixed values: 25 from 0.01 to 10,000 in equal ratios).
ALPHAS = tuple(10.0 ** (-2 + k / 4) for k in range(25))
FITS = "_fold {kind}, _set int, alpha double, n double, coefs array<double>"


@dataclass(frozen=True)
class Pool:
    """Complete rows of one model table: ``rows`` has the fold column ``by``, ``target``, ``columns`` and whatever else was kept.

    ``shift`` holds the overall mean of each column and of the target, which all sums are taken from. With ``weight`` the products are
    weighted by that column, while columns are still scaled by the deviations of unweighted rows.
    """

    rows: DataFrame
    columns: tuple[str, ...]
    target: str
    by: str
    shift: tuple[float, ...]
    weight: str | None
    sums: DataFrame  # (by, g): products of (1, columns, target) row by row, then unweighted sums and sums of squares of (1, columns)

    @property
    def size(self) -> int:
        return len(self.columns) + 2

    def total(self) -> np.ndarray:
        cells = self.size**2 + 2 * (self.size - 1)
        row = self.sums.agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(cells)]).first()  # about p x p numbers
        return np.array([row[i] or 0.0 for i in range(cells)])


def pool_of(df: DataFrame, columns: Sequence[str], target: str, by: str, keep: Sequence[str] = (), weight: str | None = None) -> Pool:
    """Rows of ``df`` complete in ``by``, all ``columns``, the target and the weight, with their sums of products by fold; rows without a positive weight are left out."""
    given = [*columns, target, *([weight] if weight else [])]
    names = list(dict.fromkeys([by, *keep, *given]))
    df = df.select(*names).withColumns({c: F.col(c).cast("double") for c in given}).dropna(subset=[by, *given])
    rows = stage(df.where(F.col(weight) > 0) if weight else df, "pool")
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*columns, target])]).first()
    shift = tuple(m or 0.0 for m in means)
    terms = [F.lit(1.0), *[F.col(c) - F.lit(m) for c, m in zip([*columns, target], shift, strict=True)]]
    p = len(terms)
    w = F.col(weight) if weight else F.lit(1.0)
    cells = [F.sum(w * terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i + 1)]
    plain = [F.sum(t if k == 1 else t * t).alias(f"u{k}_{i}") for k in (1, 2) for i, t in enumerate(terms[:-1])]
    whole = F.array(*[F.col(f"s{max(i, j)}_{min(i, j)}") for i in range(p) for j in range(p)], *[F.col(f"u{k}_{i}") for k in (1, 2) for i in range(p - 1)])
    return Pool(rows, tuple(columns), target, by, shift, weight, stage(rows.groupBy(by).agg(*cells, *plain).select(by, whole.alias("g")), "products"))


@dataclass(frozen=True)
class Decomposed:
    """A standardised set of predictors in the axes of its own correlations."""

    at: np.ndarray  # places of the set's columns
    n: float
    mean: np.ndarray  # of the set's columns, then of the target
    sd: np.ndarray
    values: np.ndarray  # of the standardised products
    axes: np.ndarray
    along: np.ndarray  # products of axes and target

    def damping(self, alphas: Sequence[float]) -> np.ndarray:
        """1 / (value + penalty) by axis and penalty; 0 for an axis without spread or penalty."""
        whole = self.values[:, None] + np.asarray(alphas, float)[None, :]
        return np.where(whole > 1e-9 * max(self.n, 1.0), 1 / np.where(whole > 0, whole, 1), 0.0)

    def coefficients(self, alpha: float, width: int) -> np.ndarray:
        """Intercept and coefficients on the shifted columns, 0 for columns outside the set."""
        beta = self.axes @ (self.along * self.damping([alpha])[:, 0]) / self.sd
        out = np.zeros(width + 1)
        out[1 + self.at] = beta
        out[0] = self.mean[-1] - beta @ self.mean[:-1]
        return out


def decompose(sums: np.ndarray, size: int, at: Sequence[int]) -> Decomposed:
    """Centres by the rows' own weighted means and scales by their unweighted population deviations; a column without spread is left as it is."""
    at, gram = np.asarray(at, int), sums[: size**2].reshape(size, size)
    count, first, second = sums[size**2], sums[size**2 + 1 : size**2 + size - 1], sums[size**2 + size :]
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    spread = gram[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(second / count - (first / count) ** 2, 0))[at]
    sd = np.where(sd < 1e-12, 1.0, sd)
    values, axes = np.linalg.eigh(spread[np.ix_(at, at)] / np.outer(sd, sd)) if len(at) else (np.zeros(0), np.zeros((0, 0)))
    return Decomposed(at, n, np.append(mean[at], mean[-1]), sd, np.maximum(values, 0), axes, axes.T @ (spread[at, -1] / sd))


def _places(pool: Pool, sets: Sequence[Sequence[str]]) -> list[list[int]]:
    return [[pool.columns.index(c) for c in s] for s in sets]


def fold_fits(pool: Pool, sets: Sequence[Sequence[str]], alphas: Sequence[float] = ALPHAS, held_out: bool = True) -> DataFrame:
    """(_fold, _set, alpha, n, coefs): for each fold and each set of ``sets`` the ridge fit on all other folds (on its own rows, unless ``held_out``).

    With several ``alphas`` the one of least leave-one-out squared error on the fitted rows is taken, the least of equal ones. ``coefs`` is the
    intercept and one coefficient for each of the pool's columns, on the raw columns; a fold without fitted rows has no fits.
    """
    places, total, kind = _places(pool, sets), pool.total(), pool.rows.schema[pool.by].dataType.simpleString()
    size, shift, width = pool.size, np.array(pool.shift), len(pool.columns)
    chosen = len(alphas) > 1
    picked = _least_errors(pool, places, alphas, total, held_out) if chosen else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                own = np.asarray(row[1], float)
                sums = total - own if held_out else own
                if sums[size**2] < 0.5:
                    continue
                for k, at in enumerate(places):
                    alpha = float(row[2][k] if chosen else alphas[0])
                    b = decompose(sums, size, at).coefficients(alpha, width)
                    b[0] += shift[-1] - b[1:] @ shift[:-1]
                    found.append((row[0], k, alpha, float(sums[size**2]), b.tolist()))
            yield pd.DataFrame(found, columns=["_fold", "_set", "alpha", "n", "coefs"])

    rows = pool.sums.withColumnRenamed(pool.by, "_fold")
    if chosen:
        rows = rows.join(picked, "_fold", "left")
    return stage(rows.mapInPandas(run, FITS.format(kind=kind)), "fits")


def _least_errors(pool: Pool, places: list[list[int]], alphas: Sequence[float], total: np.ndarray, held_out: bool) -> DataFrame:
    """(_fold, picked): for each fold the penalty of least leave-one-out error of each set, from one scan of the rows for all of them.

    A row's error without itself is e / (1 - h), with h = 1 / n + the sum over axes of z^2 / (value + penalty), times the row's weight if it has one.
    """
    spark, size, shift = pool.rows.sparkSession, pool.size, np.array(pool.shift)
    cost = 8 * sum((len(at) + 3) ** 2 for at in places)
    folds = pool.sums.count()
    parts = max(1, -(-folds * cost // BROADCAST_BYTES))  # folds whose axes are sent to the workers at once are bounded in bytes
    of_fold = F.pmod(F.xxhash64(pool.by), F.lit(parts))
    out = None
    for part in range(parts):
        found = [(r[0], total - np.asarray(r[1], float) if held_out else np.asarray(r[1], float)) for r in pool.sums.where(of_fold == part).toLocalIterator()]
        held = spark.sparkContext.broadcast([(f, [decompose(sums, size, at) for at in places]) for f, sums in found if sums[size**2] >= 0.5])

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(held.value), len(places), len(alphas)))
            for batch in batches:
                fold, y = batch.iloc[:, 0].to_numpy(), batch.iloc[:, 1].to_numpy(float) - shift[-1]
                x, w = batch.iloc[:, 3:].to_numpy(float) - shift[:-1], batch.iloc[:, 2].to_numpy(float)
                for i, (name, sets) in enumerate(held.value):
                    mine = (fold != name) if held_out else (fold == name)
                    xs, ys, ws = x[mine], y[mine], w[mine][:, None]
                    for k, d in enumerate(sets):
                        z = (xs[:, d.at] - d.mean[:-1]) / d.sd @ d.axes
                        damp = d.damping(alphas)
                        error = (ys - d.mean[-1])[:, None] - z @ (d.along[:, None] * damp)
                        hat = ws * (1 / d.n + z**2 @ damp)
                        sums[i, k] += (ws * (error / np.maximum(1 - hat, 1e-12)) ** 2).sum(axis=0)
            rows = [(f, k, j, sums[i, k, j]) for i, (f, _) in enumerate(held.value) for k in range(len(places)) for j in range(len(alphas))]
            yield pd.DataFrame(rows, columns=["_fold", "_set", "_at", "_error"])

        kind = pool.rows.schema[pool.by].dataType.simpleString()
        read = pool.rows.select(pool.by, pool.target, (F.col(pool.weight) if pool.weight else F.lit(1.0)).alias("_w"), *pool.columns)
        errors = read.mapInPandas(run, f"_fold {kind}, _set int, _at int, _error double").groupBy("_fold", "_set", "_at").agg(F.sum("_error").alias("_error"))
        least = errors.groupBy("_fold", "_set").agg(F.min(F.struct("_error", "_at")).alias("best"))
        alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("best._at") + 1)
        best = least.select("_fold", F.struct("_set", alpha.alias("alpha")).alias("x")).groupBy("_fold").agg(F.array_sort(F.collect_list("x")).alias("x"))
        best = stage(best.select("_fold", F.col("x.alpha").alias("picked")), "penalties")
        out = best if out is None else out.unionByName(best)
    return out


def scored(rows: DataFrame, pool: Pool, fits: DataFrame, sets: int = 1, prefix: str = "p") -> DataFrame:
    """``rows`` with ``prefix``0, ``prefix``1 and so on: each set's prediction by the fit of the row's fold; rows of folds without fits are left out."""
    fold = fits.groupBy("_fold").agg(F.array_sort(F.collect_list(F.struct("_set", "coefs"))).alias("_f")).select(F.col("_fold").alias(pool.by), F.col("_f.coefs").alias("_b"))
    joined = join_keyed(rows, fold, [pool.by])
    given = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in pool.columns])
    value = lambda k: F.aggregate(F.zip_with(F.col("_b")[k], given, lambda b, x: b * x), F.lit(0.0), lambda a, b: a + b)
    return joined.withColumns({f"{prefix}{k}": value(k) for k in range(sets)}).drop("_b")
