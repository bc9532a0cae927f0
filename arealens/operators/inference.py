"""Coefficients of a full-sample linear model with classical and robust errors, and spatial autocorrelation by permutation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.crossval import pool_of
from arealens.operators.joins import join_keyed
from arealens.operators.ranks import running_sum
from arealens.scratch import stage


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz), for x from 0 to 1."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t beyond |t|."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


COEFFICIENTS = "term string, coef double, se double, t double, p double, se_hc3 double, t_hc3 double, p_hc3 double, pct_effect double, stars string"
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))  # fixed: stars from the robust p value up to each bound


def ols_hc3(df: DataFrame, columns: Sequence[str], target: str) -> tuple[DataFrame, dict[str, float]]:
    """The coefficient table of an ordinary fit on standardised predictors, and (n, r2, r2_adj, f, p_f, aic) of the fit.

    Rows complete in all columns count. Errors are classical and HC3, whose weights (e / (1 - h))^2 take a second pass over the rows; p values
    come from Student's t with n - p - 1 degrees. pct_effect is 100 (exp(coef) - 1), for a target in logs. A column without spread has
    coefficient 0 and no errors. Fewer than p + 2 rows give nulls.
    """
    pool = pool_of(df.withColumn("_all", F.lit(0)), columns, target, "_all")
    sums, size, spark = pool.total(), pool.size, df.sparkSession
    gram = sums[: size**2].reshape(size, size)
    n, p = float(gram[0, 0]), len(columns)
    if n < p + 2:
        return spark.createDataFrame([(c, *[None] * 9) for c in ["const", *columns]], COEFFICIENTS), {"n": n}
    mean = gram[0, 1:] / n
    spread = gram[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(spread)[:-1], 0) / n)
    live = np.flatnonzero(sd > 1e-12)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z = (spread[:-1, :-1] / np.outer(sd, sd))[np.ix_(live, live)]
    inverse = np.linalg.pinv(z, hermitian=True)
    beta = inverse @ (spread[:-1, -1] / sd)[live]
    shift = np.array(pool.shift)
    scale = [(F.col(columns[j]) - F.lit(float(shift[j] + mean[j]))) / F.lit(float(sd[j])) for j in live]
    rows = pool.rows.select((F.col(target) - F.lit(float(shift[-1] + mean[-1]))).alias("_y"), *[s.alias(f"_z{i}") for i, s in enumerate(scale)])
    zs = [F.col(f"_z{i}") for i in range(len(live))]
    fit = sum((F.lit(float(b)) * x for b, x in zip(beta, zs, strict=True)), F.lit(0.0))
    hat = sum((F.lit(float(inverse[i, j])) * zs[i] * zs[j] for i in range(len(live)) for j in range(len(live))), F.lit(1 / n))
    rows = rows.select((F.col("_y") - fit).alias("_e"), hat.alias("_h"), F.lit(1.0).alias("_c"), *zs)
    weight = F.pow(F.col("_e") / F.greatest(1 - F.col("_h"), F.lit(1e-12)), F.lit(2))
    terms = [F.col("_c"), *zs]
    k = len(terms)
    meat_row = rows.agg(F.sum(F.col("_e") * F.col("_e")).alias("sse"), *[F.sum(weight * terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    meat = np.array([[meat_row[f"m{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
    whole = np.zeros((k, k))
    whole[0, 0], whole[1:, 1:] = 1 / n, inverse
    degrees, sse = n - len(live) - 1, meat_row["sse"]
    classic, robust = np.sqrt(np.diag(whole) * sse / degrees), np.sqrt(np.diag(whole @ meat @ whole))
    coefs = np.concatenate([[shift[-1] + mean[-1]], beta])
    found = {}
    for name, b, s, h in zip(["const", *[columns[j] for j in live]], coefs.tolist(), classic.tolist(), robust.tolist(), strict=True):
        t, th = (b / x if x > 0 else None for x in (s, h))
        tails = [None if v is None else student_tail(v, degrees) for v in (t, th)]
        stars = next((mark for bound, mark in STARS if tails[1] is not None and tails[1] <= bound), "")
        found[name] = (name, b, s, t, tails[0], h, th, tails[1], 100 * math.expm1(b), stars)
    table = spark.createDataFrame([found.get(c, (c, 0.0, None, None, None, None, None, None, 0.0, "")) for c in ["const", *columns]], COEFFICIENTS)
    sst = float(spread[-1, -1])
    r2 = 1 - sse / sst if sst > 0 else None
    summary = {"n": n, "r2": r2, "aic": n * math.log(2 * math.pi * sse / n) + n + 2 * (len(live) + 1) if sse > 0 else None}
    if r2 is not None and len(live):
        f = r2 / len(live) / ((1 - r2) / degrees) if r2 < 1 else math.inf
        summary |= {"r2_adj": 1 - (1 - r2) * (n - 1) / degrees, "f": f, "p_f": f_tail(f, len(live), degrees)}
    return table, summary


# Spatial autocorrelation


def keyed_order(df: DataFrame, by: Sequence[str], key: Sequence[str], into: str) -> DataFrame:
    """``df`` with ``into``: the place, from 0, of each row of a group in the order of the md5 of its ``key`` values joined by '-'.

    The digest's first digits cut a group into chunks of about equal size, so no task orders a whole group. Keys are unique in a group.
    """
    df = df.withColumn("_key", F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in key]))).withColumn("_one", F.lit(1).cast("long"))
    return running_sum(df, by, ["_key"], "_one", into, chunk=F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")).drop("_key", "_one")


def neighbour_links(edges: DataFrame) -> DataFrame:
    """(src, dst, j, k): each unit's neighbours numbered from 1, and how many it has; neighbours are few by construction (k nearest, contiguity)."""
    listed = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("_d"))
    return listed.select("src", F.size("_d").alias("k"), F.posexplode("_d").alias("j", "dst")).withColumn("j", F.col("j") + 1)


QUADRANTS = {(True, True): "HH", (True, False): "HL", (False, True): "LH", (False, False): "LL"}  # fixed labels: own value, then neighbours', against the mean


def local_moran(units: DataFrame, edges: DataFrame, value: str, by: str, draws: int = 99, alpha: float = 0.05) -> DataFrame:
    """(id, by, lag, i, p, label): each unit's local Moran statistic with a pseudo p value from ``draws`` conditional permutations.

    ``units`` has ``id``, ``by`` and the value; ``edges`` (src, dst) links units of one group. i is the unit's standardised value times the
    mean of its neighbours'. A draw gives a unit k values of other units of its group: those at the k places behind a keyed
    start in an order of the group that is keyed by the draw, the unit's own place left out; values are looked up by place, no group is gathered. p is
    (extreme + 1) / (draws + 1), counted on the side of the permutation distribution that i lies on. Labels are QUADRANTS where p < alpha, else
    "Not sig.", as where either value is the mean itself; units without neighbours have null i and p and "Not sig.". Null values are left out.
    """
    known = units.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select("id", by, F.col(value).cast("double").alias("_v"))
    groups = known.groupBy(by).agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"), F.count("*").alias("_n"))
    z = stage(join_keyed(known, groups, [by]).select("id", by, "_n", F.coalesce(F.try_divide(F.col("_v") - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))), F.lit(0.0)).alias("_z")), "standard_values")
    own = z.select(F.col("id").alias("src"), F.col("_z").alias("_own"), F.col(by), "_n")
    other = z.select(F.col("id").alias("dst"), F.col("_z").alias("_other"))
    links = neighbour_links(edges.join(other.select("dst"), "dst", "left_semi"))
    seen = links.join(other, "dst").groupBy("src").agg(F.avg("_other").alias("lag"), F.max("k").alias("k")).join(own, "src")
    seen = stage(seen.withColumn("i", F.col("_own") * F.col("lag")), "local_statistics")
    seeds = F.explode(F.sequence(F.lit(1), F.lit(draws)))
    placed = stage(keyed_order(z.select("id", by, "_n", "_z", seeds.alias("_d")), [by, "_d"], ["_d", "id"], "_at"), "permutations")
    # A unit's draw: k places that follow its own in the draw's order, beginning at a keyed distance; its own place is never among them.
    start = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("start"), F.col("_d").cast("string"), F.col("src").cast("string"))), 1, 8), 16, 10).cast("long")
    mine = seen.select("src", "_own", "k", "i").join(placed.select(F.col("id").alias("src"), by, "_d", F.col("_at").alias("_mine"), "_n"), "src")
    room = F.greatest(F.col("_n") - F.col("k"), F.lit(1))
    steps = F.explode(F.sequence(F.lit(0), F.least(F.col("k").cast("long"), F.col("_n") - 1) - 1))
    asked = mine.where("_n > 1").select("src", by, "_d", "_own", "i", "_n", (F.col("_mine") + 1 + F.pmod(start, room)).alias("_from"), steps.alias("_step"))
    asked = asked.select("src", by, "_d", "_own", "i", ((F.col("_from") + F.col("_step")) % F.col("_n")).alias("_at"))
    drawn = asked.join(placed.select(by, "_d", "_at", "_z"), [by, "_d", "_at"]).groupBy("src", "_d").agg((F.max("_own") * F.avg("_z")).alias("_i"), F.max("i").alias("i"))
    counts = drawn.groupBy("src").agg(F.count_if(F.col("_i") >= F.col("i")).alias("_up"), F.count("*").alias("_draws"))
    joined = units.select("id", by).join(seen.select(F.col("src").alias("id"), "_own", "lag", "i"), "id", "left").join(counts.withColumnRenamed("src", "id"), "id", "left")
    p = (F.least("_up", F.col("_draws") - F.col("_up")) + 1) / (F.col("_draws") + 1)
    label = F.lit("Not sig.")
    for (up, around), name in QUADRANTS.items():
        sides = ((F.col("_own") > 0) == up) & ((F.col("lag") > 0) == around) & (F.col("_own") != 0) & (F.col("lag") != 0)
        label = F.when((p < alpha) & sides, name).otherwise(label)
    return joined.select("id", by, "lag", "i", p.alias("p"), label.alias("label"))


def morans_i(units: DataFrame, edges: DataFrame, value: str, by: str, draws: int = 99) -> DataFrame:
    """(by, i, p): Moran's I with row-standardised weights over ``edges`` of each group, and its pseudo p value from ``draws`` permutations.

    A draw moves all values of a group: a unit has the value at its place in an order keyed by the draw. p is (extreme + 1) / (draws + 1) on the
    side that I lies on. Units without neighbours count for the spread only; without spread or edges both are null. Null values are left out.
    """
    known = units.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select("id", by, F.col(value).cast("double").alias("_v"))
    groups = known.groupBy(by).agg(F.avg("_v").alias("_m"), (F.var_pop("_v") * F.count("*")).alias("_ss"), F.count("*").alias("_n"))
    z = stage(join_keyed(known, groups.select(by, "_m"), [by]).select("id", by, (F.col("_v") - F.col("_m")).alias("_z")), "deviations")
    base = keyed_order(z.select("id", by), [by], ["id"], "_at")  # the values keep their places, the units move
    draw = F.explode(F.sequence(F.lit(1), F.lit(draws)))
    moved = keyed_order(z.select("id", by, draw.alias("_d")), [by, "_d"], ["_d", "id"], "_at")
    values = stage(base.join(z.select("id", "_z"), "id").select(by, "_at", "_z"), "placed_values")
    given = stage(moved.join(values, [by, "_at"]).select("id", by, "_d", "_z").unionByName(z.select("id", by, F.lit(0).alias("_d"), "_z")), "given_values")
    ids = z.select("id")
    links = neighbour_links(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
    ends = links.join(given.select(F.col("id").alias("src"), by, "_d", F.col("_z").alias("_a")), "src").join(given.select(F.col("id").alias("dst"), "_d", F.col("_z").alias("_b")), ["dst", "_d"])
    sums = ends.groupBy(by, "_d").agg(F.sum(F.col("_a") * F.col("_b") / F.col("k")).alias("_c"), F.sum(1 / F.col("k")).alias("_w"))
    stat = join_keyed(sums, groups, [by]).select(by, "_d", F.try_divide(F.col("_c") * F.col("_n"), F.nullif(F.col("_w") * F.col("_ss"), F.lit(0.0))).alias("_i"))
    stat = stage(stat, "statistics")
    own = stat.where("_d = 0").select(by, F.col("_i").alias("i"))
    counts = join_keyed(stat.where("_d > 0"), own, [by]).groupBy(by).agg(F.count_if(F.col("_i") >= F.col("i")).alias("_up"), F.count("i").alias("_draws"))
    p = F.when(F.col("i").isNotNull(), (F.least("_up", F.col("_draws") - F.col("_up")) + 1) / (F.col("_draws") + 1))
    return groups.select(by).join(own, by, "left").join(counts, by, "left").select(by, "i", p.alias("p"))
