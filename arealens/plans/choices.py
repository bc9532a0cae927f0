"""Queries that choose, explain and level models of several predictors: penalties, selection, screening, attribution, levels, spatial tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealens.operators import attribution, crossval, inference, levels, selection, spatial, transit, trees
from arealens.operators.ranks import medians
from arealens.plans.models import ORACLES, QUERIES, card, query, r, run
from arealens.plans.queries import KNN
from arealens.scratch import stage

__all__ = ["ORACLES", "QUERIES"]

# Two predictors of one target, each city fitted on the others with the penalty of least leave-one-out error

Y = "balance + 2 * jobs - 0.4 * population"
FIT = f"""r_t AS (SELECT geoid, id, city, jobs + 0.0 AS x1, population + 0.0 AS x2, {Y} AS y FROM areas),
    r_g AS (SELECT city, count(*) + 0.0 AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM r_t GROUP BY city),
    r_o AS (SELECT a.city, sum(b.n) AS n, sum(b.s1) AS s1, sum(b.s2) AS s2, sum(b.sy) AS sy, sum(b.s11) AS s11, sum(b.s22) AS s22, sum(b.s12) AS s12, sum(b.s1y) AS s1y, sum(b.s2y) AS s2y FROM r_g a JOIN r_g b ON a.city <> b.city GROUP BY a.city),
    r_m AS (SELECT city, n, s1 / n AS m1, s2 / n AS m2, sy / n AS my, sqrt(s11 / n - s1 * s1 / n / n) AS d1, sqrt(s22 / n - s2 * s2 / n / n) AS d2, s12 / n - s1 * s2 / n / n AS c12, s1y / n - s1 * sy / n / n AS c1, s2y / n - s2 * sy / n / n AS c2 FROM r_o),
    r_b AS (SELECT *, n + alpha AS a, n * c12 / d1 / d2 AS c, n * c1 / d1 AS k1, n * c2 / d2 AS k2 FROM r_m, (SELECT pow(10, -2 + k / 4.0) AS alpha FROM range(25) t(k))),
    r_f AS (SELECT *, (a * k1 - c * k2) / (a * a - c * c) AS b1, (a * k2 - c * k1) / (a * a - c * c) AS b2 FROM r_b),
    r_e AS (SELECT f.city, alpha, sum(pow((y - my - b1 * (x1 - m1) / d1 - b2 * (x2 - m2) / d2) / (1 - 1 / n - (a * pow((x1 - m1) / d1, 2) - 2 * c * (x1 - m1) / d1 * (x2 - m2) / d2 + a * pow((x2 - m2) / d2, 2)) / (a * a - c * c)), 2)) AS e FROM r_f f JOIN r_t t ON t.city <> f.city GROUP BY f.city, alpha),
    r_p AS (SELECT city, arg_min(alpha, e) AS alpha FROM r_e GROUP BY city),
    fit AS (SELECT f.city, f.alpha, b1 / d1 AS b1, b2 / d2 AS b2, my - b1 / d1 * m1 - b2 / d2 * m2 AS b0, m1, m2 FROM r_f f JOIN r_p p ON f.city = p.city AND f.alpha = p.alpha),
    parts AS (SELECT t.*, b1 * (x1 - m1) AS c_jobs, b2 * (x2 - m2) AS c_population, b0 + b1 * m1 + b2 * m2 AS base, b0 + b1 * x1 + b2 * x2 AS y_pred, alpha FROM r_t t JOIN fit USING (city))"""


def fitted(areas):
    """The pool of two predictors and its fold fits."""
    pool = crossval.pool_of(areas.withColumn("target", F.expr(Y)), ["jobs", "population"], "target", "city", keep=["geoid", "id"])
    return pool, crossval.fold_fits(pool, [["jobs", "population"]])


def explained(areas):
    return stage(attribution.contributions(*fitted(areas)), "explained")


@query("m4_ridge_two_predictors", "areas", sql=f"WITH {FIT} SELECT geoid, round(alpha, 6) AS alpha, round(y_pred, 4) AS y_pred FROM parts")
def _(areas):
    pool, fits = fitted(areas)
    alphas = fits.select(F.col("_fold").alias("city"), "alpha")
    return crossval.scored(pool.rows, pool, fits).join(alphas, "city").select("geoid", r("alpha").alias("alpha"), r("p0", 4).alias("y_pred"))


@query("h4_contributions", "areas", sql=f"WITH {FIT} SELECT geoid, round(c_jobs, 4) AS c_jobs, round(c_population, 4) AS c_population, round(base, 4) AS base, round(y_pred, 4) AS y_pred FROM parts")
def _(areas):
    return attribution.contributions(*fitted(areas)).select("geoid", *[r(c, 4).alias(c) for c in ("c_jobs", "c_population", "base", "y_pred")])


@query("h5_importance", "areas", sql=f"WITH {FIT} SELECT city, round(avg(abs(c_jobs)), 5) AS jobs, round(avg(abs(c_population)), 5) AS population, round(avg(abs(c_jobs + c_population)), 5) AS family FROM parts GROUP BY city")
def _(areas):
    size = lambda c: r(F.avg(F.abs(c)), 5)
    return attribution.contributions(*fitted(areas)).groupBy("city").agg(size(F.col("c_jobs")).alias("jobs"), size(F.col("c_population")).alias("population"), size(F.col("c_jobs") + F.col("c_population")).alias("family"))


@query("h7_level_push", "areas", sql=f"WITH {FIT} SELECT city, round(avg(c_jobs), 4) AS jobs, round(avg(c_population), 4) AS population, round(avg(base), 4) AS base, round(avg(y), 4) AS observed, round(avg(y_pred - y), 4) AS level_error FROM parts GROUP BY city")
def _(areas):
    mean = lambda c, name: r(F.avg(c), 4).alias(name)
    return attribution.contributions(*fitted(areas)).groupBy("city").agg(mean("c_jobs", "jobs"), mean("c_population", "population"), mean("base", "base"), mean("target", "observed"), mean(F.col("y_pred") - F.col("target"), "level_error"))


@query("h8_direction", "areas", sql=f"WITH {FIT}, k AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY c_jobs) + (count(*) OVER (PARTITION BY city, c_jobs) - 1) / 2.0 AS a, rank() OVER (PARTITION BY city ORDER BY c_population) + (count(*) OVER (PARTITION BY city, c_population) - 1) / 2.0 AS b, rank() OVER (PARTITION BY city ORDER BY y) + (count(*) OVER (PARTITION BY city, y) - 1) / 2.0 AS o FROM parts) SELECT city, CASE WHEN count(*) >= 3 THEN round(corr(a, o), 5) END AS jobs, CASE WHEN count(*) >= 3 THEN round(corr(b, o), 5) END AS population FROM k GROUP BY city")
def _(areas):
    found = attribution.direction(explained(areas), "city", "target", ["c_jobs", "c_population"])
    return found.select("city", r("c_jobs", 5).alias("jobs"), r("c_population", 5).alias("population"))


@query("h11_zero_profile", "areas", sql=f"WITH {FIT} SELECT x2 = 0 AS none, count(*) AS n, round(median(y), 4) AS middle, round(avg(c_population), 4) AS push FROM parts GROUP BY 1")
def _(areas):
    parts = explained(areas).withColumn("none", F.col("population") == 0)
    found = parts.groupBy("none").agg(F.count("*").alias("n"), r(F.avg("c_population"), 4).alias("push"))
    return found.join(medians(parts, ["none"], "target", "middle"), "none").withColumn("middle", r("middle", 4))


PERMUTED = f"""WITH {FIT}, f AS (SELECT unnest(['jobs', 'population']) AS predictor), d AS (SELECT unnest(range(1, 4)) AS rep),
    a AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY md5(cast(id AS varchar))) AS spot FROM parts),
    e AS (SELECT predictor, rep, a.city, a.id, spot, y - y_pred AS e, CASE predictor WHEN 'jobs' THEN c_jobs ELSE c_population END AS own FROM a, f, d),
    s AS (SELECT predictor, rep, city, own AS given, row_number() OVER (PARTITION BY predictor, rep, city ORDER BY md5(concat(predictor, '-', rep, '-', id))) AS spot FROM e)
    SELECT predictor, round(sum(pow(e - given + own, 2) - pow(e, 2)) / 3 / max(v), 6) AS "drop" FROM e JOIN s USING (predictor, rep, city, spot), (SELECT var_pop(y) * count(*) AS v FROM parts) GROUP BY predictor"""


@query("h1_permutation_drop", "areas", sql=PERMUTED)
def _(areas):
    return attribution.shuffled_costs(*fitted(areas), key="id").withColumn("drop", r("drop"))


# Fits of one penalty for both predictors and for each without the other, by seed of a bag (0: all rows)

ALPHA = 5.0


def sets_sql(seeds: str, bag: str) -> str:
    """Predictions p0 (both), p1 (population only) and p2 (jobs only) of every row by the fits of the other cities' rows in each seed's bag, with recalls by city."""
    hit = lambda p: f"count(*) FILTER (ty AND t{p}) AS h{p}"
    top = lambda c: f"round((rank() OVER (PARTITION BY seed, city ORDER BY {c}) + (count(*) OVER (PARTITION BY seed, city, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY seed, city), 9) >= 0.9 AS t{c[-1]}"
    sums = ", ".join(f"sum({e}) AS {n}" for n, e in {"n": "1.0", "s1": "x1", "s2": "x2", "sy": "y", "s11": "x1 * x1", "s22": "x2 * x2", "s12": "x1 * x2", "s1y": "x1 * y", "s2y": "x2 * y"}.items())
    rest = ", ".join(f"sum(b.{n}) AS {n}" for n in ("n", "s1", "s2", "sy", "s11", "s22", "s12", "s1y", "s2y"))
    return f"""t AS (SELECT id, geoid, city, jobs + 0.0 AS x1, population + 0.0 AS x2, {Y} AS y FROM areas), sd AS (SELECT unnest({seeds}) AS seed),
    g AS (SELECT seed, city, {sums} FROM t, sd WHERE {bag} GROUP BY seed, city),
    o AS (SELECT a.seed, a.city, {rest} FROM g a JOIN g b ON a.seed = b.seed AND a.city <> b.city GROUP BY a.seed, a.city),
    m AS (SELECT seed, city, n, s1 / n AS m1, s2 / n AS m2, sy / n AS my, sqrt(s11 / n - s1 * s1 / n / n) AS d1, sqrt(s22 / n - s2 * s2 / n / n) AS d2, s12 / n - s1 * s2 / n / n AS c12, s1y / n - s1 * sy / n / n AS c1, s2y / n - s2 * sy / n / n AS c2 FROM o),
    b AS (SELECT *, n + {ALPHA} AS a, n * c12 / d1 / d2 AS c, n * c1 / d1 AS k1, n * c2 / d2 AS k2 FROM m),
    p AS (SELECT b.seed, t.*, my + (a * k1 - c * k2) / (a * a - c * c) * (x1 - m1) / d1 + (a * k2 - c * k1) / (a * a - c * c) * (x2 - m2) / d2 AS p0, my + k2 / a * (x2 - m2) / d2 AS p1, my + k1 / a * (x1 - m1) / d1 AS p2 FROM t JOIN b USING (city)),
    k AS (SELECT *, {top('y')}, {top('p0')}, {top('p1')}, {top('p2')} FROM p),
    s AS (SELECT seed, city, count(*) FILTER (ty) AS worst, {hit('0')}, {hit('1')}, {hit('2')}, count(*) AS n, var_pop(y) * count(*) AS ss, sum(pow(y - p0, 2)) AS e0, sum(pow(y - p1, 2)) AS e1, sum(pow(y - p2, 2)) AS e2 FROM k GROUP BY seed, city),
    a AS (SELECT s.seed, 1 - sum(e0) / max(v) AS r0, 1 - sum(e1) / max(v) AS r1, 1 - sum(e2) / max(v) AS r2, sum(h0) / sum(worst) AS q0, sum(h1) / sum(worst) AS q1, sum(h2) / sum(worst) AS q2, avg(1 - e0 / ss) AS c0, avg(1 - e1 / ss) AS c1, avg(1 - e2 / ss) AS c2, avg(h0 / worst) AS w0, avg(h1 / worst) AS w1, avg(h2 / worst) AS w2 FROM s JOIN (SELECT seed, var_pop(y) * count(*) AS v FROM p GROUP BY seed) USING (seed) GROUP BY s.seed)"""


STEP = f"""WITH {sets_sql('[0]', 'true')}, d AS (SELECT 'jobs' AS predictor, r1 - r0 AS d, (SELECT avg(cast(h1 >= h0 AS integer)) FROM s) AS share, r1 AS r2, q1 AS recall FROM a UNION ALL SELECT 'population', r2 - r0, (SELECT avg(cast(h2 >= h0 AS integer)) FROM s), r2, q2 FROM a),
    e AS (SELECT *, d > -0.9 AND share >= 0.2 AS eligible FROM d)
    SELECT 1 AS step, 'drop' AS action, predictor, round(d, 6) AS d_r2, round(share, 6) AS share_not_worse, eligible, round(r2, 6) AS r2, round(recall, 6) AS recall, 1 AS n_predictors, eligible AND d = (SELECT max(d) FROM e WHERE eligible) AS chosen FROM e"""


@query("k3_stepwise", "areas", sql=STEP)
def _(areas):
    table = areas.withColumn("target", F.expr(Y))
    found = selection.stepwise(table, ["jobs", "population"], "target", "city", rule=selection.DropRule(0.9, 0.2), alphas=[ALPHA])
    return found.path.withColumns({c: r(c) for c in ("d_r2", "share_not_worse", "r2", "recall")})


@query("k3_forward_from_anchor", "areas")
def _(areas):
    """A longer search, with an anchor that stays and penalties chosen by leave-one-out; held against a plain search in the tests."""
    table = areas.withColumn("target", F.expr(Y)).withColumn("anchor", F.col("state").cast("double"))
    return selection.stepwise(table, ["jobs", "population", "x", "y"], "target", "city", direction="forward", fixed=["anchor"]).path


BAG = "cast(concat('0x', substr(md5(concat(seed, '-', id)), 1, 7)) AS bigint) < 214748364"


@query("h6_family_dropout", "areas", sql=f"WITH {sets_sql('[0, 1, 2]', BAG)}, u AS (SELECT city, avg(e1 / ss - e0 / ss) AS f1, avg(e2 / ss - e0 / ss) AS f2 FROM s GROUP BY city) SELECT 'work' AS family, round(avg(r0 - r1), 6) AS d_r2, round(avg(c0 - c1), 6) AS d_r2_city, round(avg(w0 - w1), 6) AS d_recall, round(stddev_samp(r0 - r1), 6) AS sd_r2, (SELECT count(*) FILTER (f1 > 0) FROM u) AS cities_helped FROM a UNION ALL SELECT 'people', round(avg(r0 - r2), 6), round(avg(c0 - c2), 6), round(avg(w0 - w2), 6), round(stddev_samp(r0 - r2), 6), (SELECT count(*) FILTER (f2 > 0) FROM u) FROM a")
def _(areas):
    table, families = areas.withColumn("target", F.expr(Y)), {"work": ["jobs"], "people": ["population"]}
    deltas, _ = attribution.family_dropout(table, ["jobs", "population"], families, "target", "city", "id", seeds=(0, 1, 2), alphas=[ALPHA])
    return deltas.withColumns({c: r(c) for c in ("d_r2", "d_r2_city", "d_recall", "sd_r2")})


PAIRED = f"SELECT city, a.r2 - b.r2 AS gain_r2, a.recall10 - b.recall10 AS gain_recall FROM {card('p', 'city')} a JOIN {card('q', 'city')} b USING (city)"


@query("k2_paired_cities", "areas", sql=f"SELECT count(*) AS cities, round(avg(gain_r2), 5) AS city_mean, round(max(pooled), 5) AS pooled, round(count(*) FILTER (gain_recall >= -1e-12) / count(*), 6) AS not_worse FROM ({PAIRED}), (SELECT a.r2 - b.r2 AS pooled FROM {card('p', chr(39) + 'all' + chr(39))} a, {card('q', chr(39) + 'all' + chr(39))} b)")
def _(areas):
    both = run(areas).select("city", "geoid", "y", F.col("p").alias("p0")).join(run(areas, True).select("geoid", F.col("p").alias("p1")), "geoid")
    found = selection.score_sets(stage(both, "both_runs"), "city", "y", 2, 0.1)
    keeps = F.coalesce(F.col("recall")[0] >= F.col("recall")[1] - selection.TIES, F.lit(False))
    cities = found.cities.agg(F.count("*").alias("cities"), r(F.avg(F.col("r2")[0] - F.col("r2")[1]), 5).alias("city_mean"), r(F.avg(keeps.cast("double"))).alias("not_worse"))
    return cities.withColumn("pooled", r(F.lit(found.pooled_r2[0] - found.pooled_r2[1]), 5))


# Screening and coefficients

CANDIDATES = ["jobs", "jobs_twin", "population", "x", "rare", "city_number"]
SCREENED = "SELECT geoid, city, jobs + 0.0 AS jobs, jobs + x / 10 AS jobs_twin, population + 0.0 AS population, x, cast(id % 50 = 0 AS integer) + 0.0 AS rare, city + x / 1000 AS city_number, balance / 50 + jobs - 0.2 * population AS target FROM areas"


def _pair(a: str, b: str) -> str:
    return f"CASE WHEN NOT isnan(corr(r_{a}, r_{b})) THEN corr(r_{a}, r_{b}) END"  # null where a rank is constant


_RANKED = ", ".join(f"rank() OVER (PARTITION BY city ORDER BY {c}) + (count(*) OVER (PARTITION BY city, {c}) - 1) / 2.0 AS r_{c}" for c in [*CANDIDATES, "target"])
_OWN = " UNION ALL ".join(f"SELECT city, '{c}' AS predictor, {_pair(c, 'target')} AS rho FROM k GROUP BY city" for c in CANDIDATES)
_NEAR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(avg(c)) AS m FROM (SELECT {_pair(a, b)} AS c FROM k GROUP BY city)" for a in CANDIDATES for b in CANDIDATES if a != b)
_SHARE = " UNION ALL ".join(f"SELECT '{c}' AS predictor, sum(pow(g - m, 2)) / sum(pow(v - m, 2)) AS share, avg(cast(v = 0 AS integer)) AS zero FROM (SELECT {c} AS v, avg({c}) OVER (PARTITION BY city) AS g, avg({c}) OVER () AS m FROM w)" for c in CANDIDATES)
SCREEN_SQL = f"""WITH w AS ({SCREENED}), k AS (SELECT city, {_RANKED} FROM w), own AS ({_OWN}), med AS (SELECT predictor, median(rho) AS mid FROM own GROUP BY predictor),
    st AS (SELECT own.predictor, max(mid) AS mid, avg(cast(sign(rho) = sign(mid) AS integer)) AS agree FROM own JOIN med USING (predictor) WHERE rho IS NOT NULL GROUP BY own.predictor), sh AS ({_SHARE}), near AS ({_NEAR}),
    v AS (SELECT predictor, mid, agree, share, zero, (abs(mid) < 0.1 AND agree < 0.8) OR (share > 0.7 AND predictor = 'city_number') OR zero > 0.95 AS early FROM sh LEFT JOIN st USING (predictor)),
    z AS (SELECT v.*, coalesce((SELECT max(m) FROM near JOIN v o ON o.predictor = b WHERE a = v.predictor AND NOT o.early AND abs(o.mid) > abs(v.mid)), 0) > 0.8 AS twin FROM v)
    SELECT predictor, round(mid, 5) AS within_rho, round(agree, 6) AS sign_agree, round(share, 5) AS between_share, round(zero, 6) AS pct_zero, CASE WHEN early OR twin THEN 'drop' ELSE 'keep' END AS verdict FROM z"""


@query("t7_screening", "areas", sql=SCREEN_SQL)
def _(areas):
    table = areas.sparkSession.sql(SCREENED.replace("FROM areas", "FROM {areas}"), areas=areas)
    found = selection.screen(stage(table, "screened"), CANDIDATES, "target", "city", artifacts=["city_number"])
    return found.select("predictor", r("within_rho", 5).alias("within_rho"), r("sign_agree").alias("sign_agree"), r("between_share", 5).alias("between_share"), r("pct_zero").alias("pct_zero"), "verdict")


_T = "(SELECT 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs({t}) / 6000 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow({t} * i / 2000, 2) / df, -(df + 1) / 2)) FROM range(0, 2001) s(i))"
OLS_SQL = f"""WITH t AS (SELECT jobs + 0.0 AS x1, population + 0.0 AS x2, ln(1 + jobs) + balance / 5000 AS y FROM areas),
    m AS (SELECT count(*) AS n, count(*) - 3.0 AS df, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2, corr(x1, x2) AS c, covar_pop(x1, y) / stddev_pop(x1) AS k1, covar_pop(x2, y) / stddev_pop(x2) AS k2 FROM t),
    b AS (SELECT *, (k1 - c * k2) / (1 - c * c) AS b1, (k2 - c * k1) / (1 - c * c) AS b2, 1 / (n * (1 - c * c)) AS i FROM m),
    e AS (SELECT n, df, c, i, my, b1, b2, (x1 - m1) / d1 AS z1, (x2 - m2) / d2 AS z2, y - my - b1 * (x1 - m1) / d1 - b2 * (x2 - m2) / d2 AS e, 1.0 / n + i * (pow((x1 - m1) / d1, 2) - 2 * c * (x1 - m1) / d1 * (x2 - m2) / d2 + pow((x2 - m2) / d2, 2)) AS h FROM t, b),
    s AS (SELECT max(n) AS n, max(df) AS df, max(i) AS i, max(my) AS my, max(b1) AS b1, max(b2) AS b2, sum(e * e) AS sse, sum(pow(e / (1 - h), 2)) AS v0, sum(pow(e / (1 - h) * i * (z1 - c * z2), 2)) AS v1, sum(pow(e / (1 - h) * i * (z2 - c * z1), 2)) AS v2 FROM e),
    o AS (SELECT 'const' AS term, my AS coef, sqrt(sse / df / n) AS se, sqrt(v0) / n AS h, df FROM s UNION ALL SELECT 'jobs', b1, sqrt(sse / df * i), sqrt(v1), df FROM s UNION ALL SELECT 'population', b2, sqrt(sse / df * i), sqrt(v2), df FROM s),
    q AS (SELECT *, greatest({_T.format(t='(coef / se)')}, 0) AS p, greatest({_T.format(t='(coef / h)')}, 0) AS p_h FROM o)
    SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 4) AS t, round(p, 4) AS p, round(h, 6) AS se_hc3, round(coef / h, 4) AS t_hc3, round(p_h, 4) AS p_hc3, round(100 * (exp(coef) - 1), 4) AS pct_effect, CASE WHEN p_h <= 0.001 THEN '***' WHEN p_h <= 0.01 THEN '**' WHEN p_h <= 0.05 THEN '*' ELSE '' END AS stars FROM q"""


@query("m5_ols_hc3", "areas", sql=OLS_SQL)
def _(areas):
    table = areas.withColumn("target", F.expr("ln(1 + jobs) + balance / 5000"))
    found, _ = inference.ols_hc3(table, ["jobs", "population"], "target")
    return found.select("term", *[r(c, 4 if c[0] in "tp" else 6).alias(c) for c in ("coef", "se", "t", "p", "se_hc3", "t_hc3", "p_hc3", "pct_effect")], "stars")


# Levels

LEVELS = "WITH t AS (SELECT city, population AS w, ln(1 + jobs) AS y, ln(1 + population / 5.0) AS p FROM areas), c AS (SELECT city, sum((exp(y) - 1) * w) / sum(w) AS obs_rate, avg(y) AS obs_log, avg(p) AS pred_log, sum((exp(p) - 1) * w) / sum(w) AS pred_rate, CASE WHEN city % 7 <> 3 THEN cast(300 + 11 * city AS double) END AS anchor FROM t GROUP BY city)"


def level_stats(areas):
    rows = areas.select("geoid", "city", F.col("population").alias("w"), F.log1p("jobs").alias("y"), F.log1p(F.col("population") / 5.0).alias("p"))
    anchors = areas.select("city").distinct().where("city % 7 <> 3").withColumn("anchor", F.lit(300.0) + 11 * F.col("city"))
    return rows, stage(levels.city_levels(rows, anchors), "city_levels")


@query("l2_leave_one_out_level", "areas", sql=f"{LEVELS} SELECT x.city, round(x.anchor, 5) AS naive, round(x.anchor * median(z.obs_rate / z.anchor), 5) AS ratio, round(regr_intercept(z.obs_log, ln(1 + z.anchor)) + regr_slope(z.obs_log, ln(1 + z.anchor)) * ln(1 + x.anchor), 5) AS loglin, round(x.obs_log, 5) AS oracle FROM c x LEFT JOIN c z ON x.city <> z.city AND z.anchor IS NOT NULL GROUP BY x.city, x.anchor, x.obs_log")
def _(areas):
    _, stats = level_stats(areas)
    out = stats.select("city")
    for m in levels.METHODS:
        out = out.join(levels.level_targets(stats, m).select("city", r("target", 5).alias(m)), "city")
    return out


@query("l3_relevel_logs", "areas", sql=f"{LEVELS}, v AS (SELECT x.city, x.pred_log, x.pred_rate, x.anchor * median(z.obs_rate / z.anchor) AS ratio, x.obs_log FROM c x LEFT JOIN c z ON x.city <> z.city AND z.anchor IS NOT NULL GROUP BY x.city, x.anchor, x.obs_log, x.pred_log, x.pred_rate) SELECT geoid, round(l + 0.5 * coalesce(ln(1 + (exp(l) - 1) * ratio / pred_rate) - l, 0), 6) AS by_ratio, round(l + 0.25 * (obs_log - pred_log), 6) AS by_oracle FROM (SELECT geoid, city, ln(1 + population / 5.0) AS l FROM areas) JOIN v USING (city)")
def _(areas):
    rows, stats = level_stats(areas)
    a = levels.relevel_run(rows, stats, "ratio", 0.5).select("geoid", r("p").alias("by_ratio"))
    return a.join(levels.relevel_run(rows, stats, "oracle", 0.25).select("geoid", r("p").alias("by_oracle")), "geoid")


# Spatial tests

DRAWS = 19
_EDGES = f"e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS j, count(*) OVER (PARTITION BY src) AS k FROM ({KNN}) WHERE rnk <= 6), dr AS (SELECT unnest(range(1, {DRAWS + 1})) AS d)"
MORAN_SQL = f"""WITH {_EDGES}, z AS (SELECT id, state, balance - avg(balance) OVER (PARTITION BY state) AS z FROM areas), b AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5(cast(id AS varchar))) AS spot FROM z),
    mv AS (SELECT id, state, d, row_number() OVER (PARTITION BY state, d ORDER BY md5(concat(d, '-', id))) AS spot FROM z, dr), v AS (SELECT mv.id, mv.state, d, b.z FROM mv JOIN b USING (state, spot) UNION ALL SELECT id, state, 0, z FROM z),
    i AS (SELECT s.state, s.d, sum(s.z * t.z / k) / max(ss) * max(n) / sum(1.0 / k) AS i FROM e JOIN v s ON s.id = src JOIN v t ON t.id = dst AND t.d = s.d JOIN (SELECT state, sum(z * z) AS ss, count(*) AS n FROM z GROUP BY state) q ON q.state = s.state GROUP BY s.state, s.d),
    o AS (SELECT a.state, a.i, count(*) FILTER (x.i >= a.i) AS up FROM i a JOIN i x ON x.state = a.state AND x.d > 0 WHERE a.d = 0 GROUP BY a.state, a.i)
    SELECT state, round(i, 6) AS i, (least(up, {DRAWS} - up) + 1) / {DRAWS + 1}.0 AS p FROM o"""


@query("x1_morans_i", "areas", sql=MORAN_SQL)
def _(areas):
    found = inference.morans_i(areas, spatial.knn(areas, 6, 12.0, ("state",)), "balance", "state", draws=DRAWS)
    return found.select("state", r("i").alias("i"), "p")


LISA_SQL = f"""WITH {_EDGES}, z AS (SELECT id, state, (balance - avg(balance) OVER (PARTITION BY state)) / stddev_pop(balance) OVER (PARTITION BY state) AS z, count(*) OVER (PARTITION BY state) AS n FROM areas),
    l AS (SELECT src, max(a.state) AS state, max(a.n) AS n, max(a.z) AS own, avg(b.z) AS lag, max(k) AS k FROM e JOIN z a ON a.id = src JOIN z b ON b.id = dst GROUP BY src), pl AS (SELECT id, state, d, z, n, row_number() OVER (PARTITION BY state, d ORDER BY md5(concat(d, '-', id))) - 1 AS spot FROM z, dr),
    st AS (SELECT src, l.state, l.n, own, lag, k, p.d, (p.spot + 1 + cast(concat('0x', substr(md5(concat('start-', p.d, '-', src)), 1, 8)) AS bigint) % (l.n - k)) AS first FROM l JOIN pl p ON p.id = src),
    s AS (SELECT src, st.d, max(own) * avg(x.z) AS i, max(own) * max(lag) AS seen FROM st JOIN (SELECT unnest(range(0, 6)) AS step) ON step < k JOIN pl x ON x.state = st.state AND x.d = st.d AND x.spot = (first + step) % st.n GROUP BY src, st.d),
    c AS (SELECT src, count(*) FILTER (i >= seen) AS up FROM s GROUP BY src), f AS (SELECT a.id, own * lag AS i, lag, own, (least(up, {DRAWS} - up) + 1) / {DRAWS + 1}.0 AS p FROM areas a LEFT JOIN l ON l.src = a.id LEFT JOIN c ON c.src = a.id)
    SELECT id, round(i, 6) AS i, p, CASE WHEN coalesce(p, 1) >= 0.06 OR own = 0 OR lag = 0 THEN 'Not sig.' ELSE concat(CASE WHEN own > 0 THEN 'H' ELSE 'L' END, CASE WHEN lag > 0 THEN 'H' ELSE 'L' END) END AS label FROM f"""


@query("x2_local_moran", "areas", sql=LISA_SQL)
def _(areas):
    found = inference.local_moran(areas, spatial.knn(areas, 6, 12.0, ("state",)), "balance", "state", draws=DRAWS, alpha=0.06)
    return found.select("id", r("i").alias("i"), "p", "label")


# Trees

STUMPS = trees.TreeParams(trees=2, depth=1, rate=0.5, bins=8, least=20)
_CUTS = " UNION ALL ".join(f"SELECT {j} AS j, unnest(quantile_cont({c}, [{', '.join(f'{i} / 8.0' for i in range(1, 8))}])) AS cut FROM t" for j, c in ((1, "x1"), (2, "x2")))


def _stump(k: int, p: str = "", cuts: str = "cuts") -> str:
    """One tree of one split for every held-out city, on the residuals of the trees before; tables of this chain begin with ``p``."""
    return f"""{p}h{k} AS (SELECT f, j, cut, count(*) AS n, sum(y - score) AS s, max(an) AS an, max(sa) AS sa FROM (SELECT *, count(*) OVER (PARTITION BY f) AS an, sum(y - score) OVER (PARTITION BY f) AS sa FROM {p}r{k} WHERE city <> f), {cuts} WHERE CASE j WHEN 1 THEN x1 ELSE x2 END <= cut GROUP BY f, j, cut),
    {p}g{k} AS (SELECT *, s * s / (n + 1) + (sa - s) * (sa - s) / (an - n + 1) - sa * sa / (an + 1) AS gain FROM {p}h{k} WHERE n >= 20 AND an - n >= 20),
    {p}b{k} AS (SELECT * FROM {p}g{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(gain, 9) DESC, j, cut) = 1),
    {p}r{k + 1} AS (SELECT r.f, r.id, r.city, x1, x2, y, score + 0.5 * CASE WHEN CASE j WHEN 1 THEN x1 ELSE x2 END <= cut THEN s / (n + 1) ELSE (sa - s) / (an - n + 1) END AS score FROM {p}r{k} r JOIN {p}b{k} USING (f))"""


STUMP_SQL = f"WITH t AS (SELECT id, city, jobs + 0.0 AS x1, population + 0.0 AS x2, {Y} AS y FROM areas), cuts AS (SELECT DISTINCT * FROM ({_CUTS})), c AS (SELECT a.city AS f, sum(b.y) / count(*) AS base FROM (SELECT DISTINCT city FROM t) a JOIN t b ON a.city <> b.city GROUP BY a.city), r1 AS (SELECT f, t.*, base AS score FROM c, t), {_stump(1)}, {_stump(2)}"


def stumps(areas):
    return trees.boosted_folds(areas.withColumn("target", F.expr(Y)), ["jobs", "population"], "target", "city", STUMPS, keep=["id"])


@query("m7_boosted_trees", "areas", sql=f"{STUMP_SQL} SELECT id, round(score, 4) AS y_pred FROM r3 WHERE f = city")
def _(areas):
    return stumps(areas).rows.select("id", r("y_pred", 4).alias("y_pred"))


@query("h3_gain_shares", "areas", sql=f"{STUMP_SQL}, u AS (SELECT CASE j WHEN 1 THEN 'jobs' ELSE 'population' END AS predictor, gain FROM (SELECT j, gain FROM b1 UNION ALL SELECT j, gain FROM b2)) SELECT predictor, round(sum(gain) / (SELECT sum(gain) FROM u), 6) AS share FROM u GROUP BY predictor")
def _(areas):
    return trees.gain_shares(stumps(areas)).withColumn("share", r("share"))


_R2 = "(SELECT 1 - sum(pow(y - score, 2)) / (var_pop(y) * count(*)) FROM {t} WHERE f = city)"


@query("k4_confirm_with_trees", "areas", sql=f"{STUMP_SQL}, one AS (SELECT * FROM cuts WHERE j = 1), or1 AS (SELECT * FROM r1), {_stump(1, 'o', 'one')}, {_stump(2, 'o', 'one')} SELECT round({_R2.format(t='r3')}, 6) AS r2_full, round({_R2.format(t='or3')}, 6) AS r2_reduced, round({_R2.format(t='or3')} - {_R2.format(t='r3')}, 6) AS d_r2")
def _(areas):
    table = areas.withColumn("target", F.expr(Y))
    found = trees.confirm(table, ["jobs", "population"], ["jobs"], "target", "city", "id", params=STUMPS)
    return areas.sparkSession.createDataFrame([tuple(round(found[c], 6) for c in ("r2_full", "r2_reduced", "d_r2"))], "r2_full double, r2_reduced double, d_r2 double")


# Builds

_ON = ", ".join(f"CASE WHEN n_nationkey % {k} = 0 THEN '1' ELSE '0' END AS {d}" for d, k in (("monday", 1), ("tuesday", 1), ("wednesday", 1), ("thursday", 2), ("friday", 2), ("saturday", 3), ("sunday", 5)))
FEED = {
    "stops": ("customer", "SELECT cast(c_custkey AS varchar(20)) AS stop_id, ((c_custkey * 7919) % 10007) / 1e2 AS stop_lon, ((c_custkey * 104729) % 10009) / 1e2 AS stop_lat FROM customer WHERE (c_custkey * 7919) % 10007 < 7500"),
    "routes": ("nation", "SELECT cast(n_nationkey AS varchar(20)) AS route_id, cast(n_nationkey % 4 AS varchar(20)) AS route_type FROM nation"),
    "trips": ("orders", "SELECT cast(o_orderkey AS varchar(20)) AS trip_id, cast(o_custkey % 25 AS varchar(20)) AS route_id, cast(o_orderkey % 7 AS varchar(20)) AS service_id FROM orders"),
    "stop_times": ("lineitem", "SELECT cast(l_orderkey AS varchar(20)) AS trip_id, cast(l_suppkey * 15 + l_linenumber AS varchar(20)) AS stop_id, concat(cast(l_partkey % 28 AS varchar(20)), ':', lpad(cast(l_linenumber * 7 AS varchar(20)), 2, '0'), ':00') AS departure_time FROM lineitem"),
    "calendar": ("nation", f"SELECT cast(n_nationkey AS varchar(20)) AS service_id, {_ON}, '19950601' AS start_date, '19950630' AS end_date FROM nation WHERE n_nationkey < 7"),
    "calendar_dates": ("region", "SELECT cast(r_regionkey AS varchar(20)) AS service_id, concat('199506', cast(12 + r_regionkey AS varchar(20))) AS date, cast(1 + r_regionkey % 2 AS varchar(20)) AS exception_type FROM region"),
    "frequencies": ("orders", "SELECT cast(o_orderkey AS varchar(20)) AS trip_id, '05:30:00' AS start_time, concat(cast(9 + o_orderkey % 20 AS varchar(20)), ':00:00') AS end_time, '1800' AS headway_secs FROM orders WHERE o_orderkey % 50 = 1"),
}
_SECONDS = "(cast(split_part({c}, ':', 1) AS bigint) * 3600 + cast(split_part({c}, ':', 2) AS bigint) * 60 + cast(split_part({c}, ':', 3) AS bigint))"
TRANSIT_SQL = f"""WITH {', '.join(f'{k} AS ({v})' for k, (_, v) in FEED.items())},
    days AS (SELECT service_id, cast(unnest(range(DATE '1995-06-01', DATE '1995-07-01', INTERVAL 1 DAY)) AS date) AS day, [sunday, monday, tuesday, wednesday, thursday, friday, saturday] AS runs FROM calendar),
    changes AS (SELECT service_id, cast(strptime(date, '%Y%m%d') AS date) AS day, exception_type FROM calendar_dates),
    serving AS (SELECT service_id, day FROM days WHERE runs[dayofweek(day) + 1] = '1' AND (service_id, day) NOT IN (SELECT (service_id, day) FROM changes WHERE exception_type = '2') UNION SELECT service_id, day FROM changes WHERE exception_type = '1'),
    daily AS (SELECT day, sum(n) AS n FROM serving JOIN (SELECT service_id, count(*) AS n FROM trips GROUP BY service_id) USING (service_id) WHERE isodow(day) < 6 GROUP BY day),
    chosen AS (SELECT day FROM daily WHERE n >= 0.8 * (SELECT max(n) FROM daily) ORDER BY abs(date_diff('day', day, DATE '1995-06-15')), day LIMIT 1),
    often AS (SELECT trip_id, floor(({_SECONDS.format(c='end_time')} - {_SECONDS.format(c='start_time')}) / 1800) AS runs, {_SECONDS.format(c='start_time')} AS a, {_SECONDS.format(c='end_time')} AS b FROM frequencies),
    tm AS (SELECT stop_id, coalesce(runs, 1) AS runs, coalesce(a, {_SECONDS.format(c='departure_time')}) AS a, coalesce(b, {_SECONDS.format(c='departure_time')}) AS b, route_type FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id) JOIN serving USING (service_id) JOIN chosen USING (day) LEFT JOIN often USING (trip_id)),
    stop AS (SELECT s.stop_id, stop_lon AS x, stop_lat AS y, coalesce(sum(runs), 0) AS n_trips, coalesce(min(a) < 18000 OR max(b) >= 86400, false) AS overnight, coalesce(list(DISTINCT route_type) FILTER (route_type IS NOT NULL), []) AS kinds FROM stops s LEFT JOIN tm ON tm.stop_id = s.stop_id GROUP BY s.stop_id, stop_lon, stop_lat),
    flag AS (SELECT stop.*, EXISTS (SELECT 1 FROM facilities f WHERE pow(f.x - stop.x, 2) + pow(f.y - stop.y, 2) <= 4) AS risky, floor(x / 20) + 5 * floor(y / 20) AS geoid FROM stop),
    sums AS (SELECT geoid, count(*) AS stop_count, sum(n_trips) AS service_intensity, count(*) FILTER (overnight) AS overnight_count, avg(cast(overnight AS integer)) AS overnight_share, count(*) FILTER (risky) AS risky_count, avg(cast(risky AS integer)) AS risky_share, count(*) FILTER (risky AND overnight) AS risky_allnight_count FROM flag GROUP BY geoid),
    mode AS (SELECT geoid, CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 0 END AS div FROM (SELECT geoid, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY geoid) AS t FROM (SELECT geoid, unnest(kinds) AS kind FROM flag) GROUP BY geoid, kind) GROUP BY geoid),
    far AS (SELECT n_nationkey AS k, min(sqrt(pow(20 * (n_nationkey % 5) + 10 - x, 2) + pow(20 * (n_nationkey // 5) + 10 - y, 2))) AS d FROM nation, stop GROUP BY n_nationkey)
    SELECT cast(n_nationkey AS bigint) AS geoid, coalesce(stop_count, 0) AS stop_count, cast(coalesce(service_intensity, 0) AS bigint) AS service_intensity, coalesce(overnight_count, 0) AS overnight_count, round(coalesce(overnight_share, 0), 6) AS overnight_share, coalesce(risky_count, 0) AS risky_count, round(coalesce(risky_share, 0), 6) AS risky_share, coalesce(risky_allnight_count, 0) AS risky_allnight_count,
        round(coalesce(div, 0), 6) AS mode_diversity, round(d, 6) AS nearest_stop, round(coalesce(stop_count, 0) / 400, 6) AS stop_density FROM nation LEFT JOIN sums ON geoid = n_nationkey LEFT JOIN mode ON mode.geoid = n_nationkey JOIN far ON k = n_nationkey"""


@query("l9_transit_build", "customer", "nation", "orders", "lineitem", "region", "facilities", sql=TRANSIT_SQL)
def _(customer, nation, orders, lineitem, region, facilities):
    given = {"customer": customer, "nation": nation, "orders": orders, "lineitem": lineitem, "region": region}
    feed = {k: transit.feed_table(given[t].sparkSession.sql(v.replace(f"FROM {t}", "FROM {t}"), t=given[t]), k) for k, (t, v) in FEED.items()}
    west, south = 20.0 * (F.col("n_nationkey") % 5), 20.0 * F.floor(F.col("n_nationkey") / 5)
    corner = lambda dx, dy: F.struct((west + dx).alias("x"), (south + dy).alias("y"))
    squares = nation.select(F.col("n_nationkey").cast("long").alias("geoid"), F.array(*[corner(*d) for d in ((0, 0), (20, 0), (20, 20), (0, 20), (0, 0))]).alias("ring"))
    found = transit.transit_build(feed, facilities, squares, 2.0, 5.0, "1995-06-15")
    return found.withColumns({c: r(c) for c in ("overnight_share", "risky_share", "mode_diversity", "nearest_stop", "stop_density")})
