"""Linear models from Gram matrices: one pass of sums per group, small solves on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.ranks import quantiles


def grams(df: DataFrame, columns: Sequence[str], target: str, by: str) -> dict[object, np.ndarray]:
    """Per group the matrix of sums of products of (1, columns, target), over rows where none is null. The driver gets p x p numbers a group."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(target).cast("double")]
    p = len(names)
    cells = [F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = {}
    for r in df.dropna(subset=[*columns, target]).groupBy(by).agg(*cells).collect():
        m = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r[by]] = m
    return out


def ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients on raw columns of a ridge fit on standardised ones (population deviations, 0 taken as 1)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(centred)[:-1], 0))
    sd[sd < 1e-12] = 1.0
    corr = centred[:-1, :-1] / np.outer(sd, sd)
    beta = np.linalg.lstsq(corr + alpha / n * np.eye(len(sd)), centred[:-1, -1] / sd, rcond=None)[0] / sd
    return np.concatenate([[mean[-1] - beta @ mean[:-1]], beta])


def inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(predictor, vif): the diagonal of the inverse correlation matrix, null where it is singular; medians stand for nulls."""
    found = {row["column"]: row["q"][0] for row in quantiles(df, [], columns, [0.5]).collect()}  # one row a column
    middle = df.sparkSession.range(1).select(*[F.lit(found.get(c)).cast("double").alias(c) for c in columns])
    filled = df.crossJoin(F.broadcast(middle.toDF(*[f"_m_{c}" for c in columns]))).select(F.lit(0).alias("_g"), *[F.coalesce(F.col(c).cast("double"), f"_m_{c}").alias(c) for c in columns])  # one row
    gram = grams(filled, columns[:-1], columns[-1], "_g").get(0)
    if gram is None:
        return df.sparkSession.createDataFrame([], "predictor string, vif double")
    mean = gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / gram[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    full = bool((sd > 0).all()) and np.linalg.matrix_rank(cov / np.outer(sd, sd)) == len(columns)
    vif = np.diag(np.linalg.inv(cov / np.outer(sd, sd))).tolist() if full else [None] * len(columns)
    return df.sparkSession.createDataFrame(list(zip(columns, vif, strict=True)), "predictor string, vif double")


def loco_coefficients(df: DataFrame, columns: Sequence[str], target: str, by: str, alpha: float = 0.0) -> DataFrame:
    """(_g, _b0, _b1, ...): for each group the fit on all others, whose sums are the total less its own; one row a group."""
    by_group = grams(df, columns, target, by)
    total = sum(by_group.values(), np.zeros((len(columns) + 2,) * 2))
    fits = [(g, *map(float, ridge(total - m, alpha))) for g, m in by_group.items() if (total - m)[0, 0] > 0]
    kind = df.schema[by].dataType.simpleString()
    return df.sparkSession.createDataFrame(fits, f"_g {kind}, _b0 double" + "".join(f", _b{i + 1} double" for i in range(len(columns))))


def loco_ridge(df: DataFrame, columns: Sequence[str], target: str, by: str, alpha: float = 0.0) -> DataFrame:
    """``df`` with y_pred: each group scored by the fit on all others."""
    coefs = loco_coefficients(df, columns, target, by, alpha)
    score = F.col("_b0")
    for i, c in enumerate(columns):
        score = score + F.col(f"_b{i + 1}") * F.col(c)
    return df.dropna(subset=[*columns, target]).join(F.broadcast(coefs), F.col(by) == F.col("_g")).select(*df.columns, score.alias("y_pred"))


def rest_r2(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, n, r2): rows and r2 of the line of y on x over all other groups' rows that have both, from each group's sums."""
    rows = df.dropna(subset=[x, y]).select(by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    terms = {"n": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") * F.col("_y")}
    own = rows.groupBy(by).agg(*[F.sum(c).alias(f"_s{k}") for k, c in terms.items()])
    total = own.agg(*[F.sum(f"_s{k}").alias(f"_t{k}") for k in terms])
    rest = own.crossJoin(F.broadcast(total)).withColumns({f"_{k}": F.col(f"_t{k}") - F.col(f"_s{k}") for k in terms})  # one row
    r2 = F.try_divide(F.expr("pow(_n * _xy - _x * _y, 2)"), F.expr("(_n * _xx - _x * _x) * (_n * _yy - _y * _y)"))
    return rest.select(by, F.col("_n").cast("long").alias("n"), r2.alias("r2"))
