"""What predictors do in fold fits: contributions, what shuffling one or leaving out a family costs, and by city."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.crossval import ALPHAS, Pool, fold_fits, pool_of, scored
from arealens.operators.inference import keyed_order
from arealens.operators.joins import join_keyed
from arealens.operators.ranks import mean_ranks, medians, quantiles
from arealens.operators.reports import safe_corr
from arealens.operators.selection import city_rank_correlations, score_sets
from arealens.scratch import discard, stage


def fitted_means(pool: Pool) -> DataFrame:
    """(_fold, means): the means of the pool's columns over the rows that each fold's fit was made on."""
    size = pool.size
    total = pool.total()
    rest = lambda i: F.lit(float(total[i])) - F.col("g")[i]
    count = rest(size**2)
    means = [F.try_divide(rest(size**2 + 1 + j), count) + F.lit(pool.shift[j]) for j in range(len(pool.columns))]
    return pool.sums.select(F.col(pool.by).alias("_fold"), F.array(*means).alias("means"))


def contributions(pool: Pool, fits: DataFrame) -> DataFrame:
    """The pool's rows with y_pred, base and, for each column, c_<column>: coefficient times distance from the mean of the fitted rows.

    All come from the fit that has not seen the row's fold; base is that fit at the means, and base and contributions add up to y_pred.
    """
    own = fits.where("_set = 0").join(fitted_means(pool), "_fold").select(F.col("_fold").alias(pool.by), F.col("coefs").alias("_b"), F.col("means").alias("_m"))
    rows = join_keyed(pool.rows, own, [pool.by])
    parts = {f"c_{c}": F.col("_b")[j + 1] * (F.col(c) - F.col("_m")[j]) for j, c in enumerate(pool.columns)}
    base = F.aggregate(F.zip_with(F.slice("_b", 2, len(pool.columns)), "_m", lambda b, m: b * m), F.col("_b")[0], lambda a, b: a + b)
    rows = rows.withColumns(parts).withColumn("base", base)
    return rows.withColumn("y_pred", sum((F.col(c) for c in parts), F.col("base"))).drop("_b", "_m")


def shuffled_costs(pool: Pool, fits: DataFrame, key: str, repeats: int = 3) -> DataFrame:
    """(predictor, drop): by how much r2 over all rows falls, on average over ``repeats``, when a predictor is shuffled within each fold.

    Fits stay as they are. The value that a row is given is that of the row with the same place in an order keyed by predictor and repeat; places
    come from digests of ``key`` (unique in the pool), so no fold is gathered. A predictor that is constant in every fold has null.
    """
    varies = pool.rows.groupBy(pool.by).agg(*[(F.max(c) > F.min(c)).alias(c) for c in pool.columns])
    flags = varies.agg(*[F.max(c).alias(c) for c in pool.columns]).first()
    live = [c for c in pool.columns if flags[c]]
    rows = stage(contributions(pool, fits), "contributions").withColumn("_y", F.col(pool.target))
    spread = rows.agg((F.var_pop("_y") * F.count("*")).alias("s")).first()["s"]
    spark = rows.sparkSession
    none = spark.createDataFrame([(c, None) for c in pool.columns if c not in live], "predictor string, drop double")
    if not live or not spread:
        return none if not live else spark.createDataFrame([(c, None) for c in pool.columns], "predictor string, drop double")
    base = keyed_order(rows.select(key, pool.by), [pool.by], [key], "_at").drop(pool.by)
    error = F.col("_y") - F.col("y_pred")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(f"c_{c}").alias("_part")) for c in live]))
    each = rows.select(key, pool.by, error.alias("_e"), cells.alias("x")).select(key, pool.by, "_e", "x.*").join(base, key)
    each = stage(each.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))), "parts")
    names = stage(keyed_order(each.select(key, pool.by, "predictor", "_rep", "_part"), [pool.by, "predictor", "_rep"], ["predictor", "_rep", key], "_at"), "shuffled")
    met = each.join(names.select(pool.by, "predictor", "_rep", "_at", F.col("_part").alias("_given")), [pool.by, "predictor", "_rep", "_at"])
    # The shuffled value's contribution stands in for the own one: the coefficient and the mean are the fold's.
    moved = met.groupBy("predictor").agg((F.sum(F.pow(F.col("_e") - F.col("_given") + F.col("_part"), F.lit(2)) - F.pow("_e", F.lit(2))) / repeats / F.lit(float(spread))).alias("drop"))
    return moved.unionByName(none)


def families_of(columns: Sequence[str], families: Mapping[str, Sequence[str]], other: str = "other") -> dict[str, list[str]]:
    """Columns by family, in the order in which families are first met; ``families`` names the members of each."""
    member = {c: f for f, cs in families.items() for c in cs}
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(member.get(c, other), []).append(c)
    return out


def family_dropout(
    df: DataFrame, columns: Sequence[str], families: Mapping[str, Sequence[str]], target: str, by: str, key: str, *, seeds: Sequence[int] = (0,), bag: float = 0.8, net: float = 0.1, alphas: Sequence[float] = ALPHAS
) -> tuple[DataFrame, DataFrame]:
    """What each family of predictors is worth: (deltas, by_city).

    For each seed all fits are made on the same ``bag`` of the rows, drawn by a digest of seed and key, with all columns and without each family,
    and scored on all rows complete in every column. deltas: (family, d_r2, d_r2_city, d_recall, sd_r2, cities_helped): full less without, mean over seeds,
    the deviation of d_r2 over seeds (null for one), and the cities whose r2 the family raises on average. by_city: (by, family, d_r2).
    """
    groups = families_of(columns, families)
    sets = [list(columns), *[[c for c in columns if c not in g] for g in groups.values()]]
    rows = stage(df.dropna(subset=[by, key, target, *columns]).select(by, key, target, *columns), "rows")
    found, cities = [], None
    for seed in seeds:
        digest = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), 1, 7), 16, 10).cast("long")
        pool = pool_of(rows.where(digest < int(bag * 16**7)), columns, target, by)
        fits = fold_fits(pool, sets, alphas)
        table = stage(scored(rows, pool, fits, len(sets)), "scored")
        s = score_sets(table, by, target, len(sets), net)
        found += [(f, s.pooled_r2[0] - s.pooled_r2[k], s.mean_r2[0] - s.mean_r2[k], s.mean_recall[0] - s.mean_recall[k]) for k, f in enumerate(groups, 1)]
        own = s.cities.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("family"), (F.col("r2")[0] - F.col("r2")[k]).alias("d")) for k, f in enumerate(groups, 1)])).alias("x")).select(by, "x.*")
        cities = own if cities is None else cities.unionByName(own)
        discard(fits, table)
    by_city = stage(cities.groupBy(by, "family").agg(F.avg("d").alias("d_r2")), "dropout_by_city")
    helped = by_city.groupBy("family").agg(F.count_if(F.col("d_r2") > 0).alias("cities_helped"))
    each = rows.sparkSession.createDataFrame(found, "family string, r double, c double, k double")
    deltas = each.groupBy("family").agg(F.avg("r").alias("d_r2"), F.avg("c").alias("d_r2_city"), F.avg("k").alias("d_recall"), F.stddev_samp("r").alias("sd_r2")).join(helped, "family")
    return deltas, by_city


def direction(rows: DataFrame, by: str, outcome: str, parts: Sequence[str]) -> DataFrame:
    """(by, one column for each of ``parts``): rank correlation of a contribution with the outcome in each group; null under three rows or without spread."""
    ranked = mean_ranks(rows.select(by, outcome, *parts), [by], {c: f"_r{i}" for i, c in enumerate([outcome, *parts])})
    return ranked.groupBy(by).agg(*[F.when(F.count("*") >= 3, safe_corr(F.col(f"_r{i}"), F.col("_r0"))).alias(c) for i, c in enumerate(parts, 1)])


def city_features(pool: Pool, fits: DataFrame, city: object, key: str, repeats: int = 3) -> DataFrame:
    """One held-out city, a row for each predictor: share (of the city's mean absolute contributions), drop (of its r2 when shuffled among its rows),
    local_rho and others_rho (rank correlation with the target there, and the median over the other cities), model_dir (rank correlation with its own
    contribution), agrees (one sign), pctile (where the city's median lies among the others' rows, equal values counting half).

    A predictor that is constant in the city has null drop, correlations, direction and agreement.
    """
    own = replace(pool, rows=pool.rows.where(F.col(pool.by) == F.lit(city)))
    rows = stage(contributions(own, fits), "city_contributions")
    names = list(pool.columns)
    melt = lambda prefix, what: F.explode(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(f"{prefix}{c}").alias(what)) for c in names])).alias("x")
    size = rows.select(melt("c_", "v")).select("x.*").groupBy("predictor").agg(F.avg(F.abs("v")).alias("_size"))
    share = size.crossJoin(F.broadcast(size.agg(F.sum("_size").alias("_all")))).select("predictor", F.try_divide("_size", "_all").alias("share"))  # one row
    rho = stage(city_rank_correlations(pool.rows, names, pool.by, pool.target).where(F.col("_b") == pool.target).select(pool.by, F.col("_a").alias("predictor"), F.col("_r").alias("rho")), "city_rhos")
    here = F.col(pool.by) == F.lit(city)
    local = rho.where(here).select("predictor", F.col("rho").alias("local_rho"))
    others = medians(rho.where(~here), ["predictor"], "rho", "others_rho")
    ranked = mean_ranks(rows.select(pool.by, *names, *[f"c_{c}" for c in names]), [pool.by], {c: f"_r_{c}" for c in [*names, *[f"c_{c}" for c in names]]})
    way = ranked.agg(*[safe_corr(F.col(f"_r_{c}"), F.col(f"_r_c_{c}")).alias(c) for c in names]).select(melt("", "model_dir")).select("x.*")
    middle = quantiles(own.rows, [], names, [0.5]).select(F.col("column").alias("predictor"), F.col("q")[0].alias("_mid"))
    rest = pool.rows.where(~here).select(melt("", "v")).select("x.*").join(F.broadcast(middle), "predictor")  # one row a predictor
    place = rest.groupBy("predictor").agg(((F.count_if(F.col("v") < F.col("_mid")) + 0.5 * F.count_if(F.col("v") == F.col("_mid"))) / F.count("*")).alias("pctile"))
    out = share
    for part in (shuffled_costs(own, fits, key, repeats), local, others, way, place):
        out = out.join(part, "predictor", "left")
    constant = F.col("local_rho").isNull()
    return out.withColumn("others_rho", F.when(~constant, F.col("others_rho"))).withColumn("agrees", F.signum("local_rho") == F.signum("model_dir"))
