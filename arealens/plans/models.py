"""Queries of the model half of the inventory: splits, fits, scorecards, comparisons, levels, overlays and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arealens.functions import columns as C
from arealens.functions import projection
from arealens.operators import overlay, ranks, regression, scores, spatial
from arealens.operators.joins import join_keyed
from arealens.plans.inventory import ORACLES, QUERIES, query, r
from arealens.plans.queries import FITS, KNN

__all__ = ["ORACLES", "QUERIES"]

# Sources, functions, space


@query("s6_sql_template", "areas", sql="SELECT city, count(*) AS n FROM areas WHERE population >= 100 AND segment LIKE '%E%' GROUP BY city")
def _(areas):
    template = "SELECT city, count(*) AS n FROM {store} WHERE population >= :floor AND segment LIKE :pattern GROUP BY city"
    return areas.sparkSession.sql(template, args={"floor": 100, "pattern": "%E%"}, store=areas)


@query("a22_service_date", "orders", sql="WITH s AS (SELECT o_orderkey AS id, cast(o_orderdate AS date) AS d, unnest(range(0, 10)) AS k FROM orders), t AS (SELECT cast(d + cast(k AS integer) AS date) AS day, count(*) AS trips FROM s WHERE (id + k) % 13 <> 0 GROUP BY 1), p AS (SELECT day, trips, max(trips) OVER (PARTITION BY dayofweek(day)) AS peak, dayofweek(day) AS weekday FROM t) SELECT weekday, cast(day AS varchar) AS day, trips FROM p WHERE trips >= 0.8 * peak QUALIFY row_number() OVER (PARTITION BY weekday ORDER BY abs(date_diff('day', day, DATE '1995-06-15')), day) = 1")
def _(orders):
    # Services run ten days from their start; an exception takes a day out.
    runs = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).where("(id + k) % 13 <> 0")
    trips = runs.groupBy(F.date_add("d", F.col("k")).alias("day")).agg(F.count("*").alias("trips")).withColumn("weekday", (F.dayofweek("day") - 1).cast("long"))
    peaks = trips.groupBy("weekday").agg(F.max("trips").alias("peak"))
    near = trips.join(peaks, "weekday").where("trips >= 0.8 * peak")
    best = near.groupBy("weekday").agg(F.min_by(F.struct("day", "trips"), F.struct(F.abs(F.datediff("day", F.lit("1995-06-15").cast("date"))), "day")).alias("b"))
    return best.select("weekday", F.col("b.day").cast("string").alias("day"), "b.trips")


@query("f3_benchmarks", "areas", sql="SELECT geoid, round(balance / 7.0, 3) AS a, round(1000.0 * jobs / nullif(population, 0), 3) AS b FROM areas WHERE population <> 0 ORDER BY geoid LIMIT 1")
def _(areas):
    values = areas.select("geoid", (F.col("balance") / 7.0).alias("a"), C.rate(F.col("jobs"), F.col("population")).alias("b"))
    return values.dropna().orderBy("geoid").limit(1).select("geoid", r("a", 3).alias("a"), r("b", 3).alias("b"))


@query("f7_log_targets", "areas", sql="SELECT geoid, round(ln(1 + jobs), 6) AS log_count, round(ln(1 + 1000.0 * jobs / nullif(population, 0)), 6) AS log_rate FROM areas")
def _(areas):
    return areas.select("geoid", r(F.log1p("jobs")).alias("log_count"), r(F.log1p(C.rate(F.col("jobs"), F.col("population")))).alias("log_rate"))


def albers_sql() -> str:
    p = projection
    one, two, zero = (p.math.radians(p.ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (p._m(one) ** 2 - p._m(two) ** 2) / (p._q(two) - p._q(one))
    c = p._m(one) ** 2 + n * p._q(one)
    q = f"(1 - {p.E**2!r}) * (s / (1 - {p.E**2!r} * s * s) - ln((1 - {p.E!r} * s) / (1 + {p.E!r} * s)) / {2 * p.E!r})"
    return f"SELECT geoid, round({p.SEMI_MAJOR / n!r} * sqrt({c!r} - {n!r} * q) * sin({n!r} * radians(x - 130 + 96)), 2) AS east, round({p.SEMI_MAJOR / n * p.math.sqrt(c - n * p._q(zero))!r} - {p.SEMI_MAJOR / n!r} * sqrt({c!r} - {n!r} * q) * cos({n!r} * radians(x - 130 + 96)), 2) AS north FROM (SELECT geoid, x, {q} AS q FROM (SELECT geoid, x / 2 AS x, sin(radians(25 + y / 5)) AS s FROM areas))"


@query("f16_equal_area", "areas", sql=albers_sql())
def _(areas):
    east, north = projection.albers(F.col("x") / 2 - 130, 25 + F.col("y") / 5)
    return areas.select("geoid", r(east, 2).alias("east"), r(north, 2).alias("north"))


PLANE = {"lat1": 42.1, "lat2": 43.666666666666664, "lat0": 41.5, "lon0": -84.36666666666666}


def lambert_sql() -> str:
    p, (n, f, rho0) = projection, projection.lambert_constants(PLANE["lat1"], PLANE["lat2"], PLANE["lat0"])
    inner = f"SELECT geoid, x, y, pow(sqrt(x * x + pow({rho0!r} - y, 2)) / {f!r}, {1 / n!r}) AS t FROM (SELECT geoid, x * 1e3 AS x, y * 2e3 AS y FROM areas)"
    inner = f"SELECT *, pi() / 2 - 2 * atan(t) AS p FROM ({inner})"
    for _ in range(5):
        inner = f"SELECT geoid, x, y, t, pi() / 2 - 2 * atan(t * pow((1 - {p.E!r} * sin(p)) / (1 + {p.E!r} * sin(p)), {p.E / 2!r})) AS p FROM ({inner})"
    return f"SELECT geoid, round(degrees(atan2(x, {rho0!r} - y) / {n!r}) + {PLANE['lon0']!r}, 7) AS lon, round(degrees(p), 7) AS lat FROM ({inner})"


@query("f17_state_plane", "areas", sql=lambert_sql())
def _(areas):
    lon, lat = projection.lambert_inverse(F.col("x") * 1e3, F.col("y") * 2e3, **PLANE)
    return areas.select("geoid", r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


def kite(x, y, size):
    """A closed ring of four corners around a point."""
    corner = lambda dx, dy: F.struct((x + dx * size).alias("x"), (y + dy * size).alias("y"))
    return F.array(*[corner(dx, dy) for dx, dy in ((-1, -1), (1, -1), (1, 2), (-1, 1), (-1, -1))])


@query("f18_polygon_measures", "facilities", sql="SELECT id, round(5 * r * r, 6) AS area, round(x + r / 15, 6) AS cx, round(y + 4 * r / 15, 6) AS cy, round(r * (2 + 3 + sqrt(5) + 2), 6) AS length FROM facilities")
def _(facilities):
    found = facilities.select("id", overlay.ring_measures(kite(F.col("x"), F.col("y"), F.col("r"))).alias("m"))
    return found.select("id", *[r(f"m.{c}").alias(c) for c in ("area", "cx", "cy", "length")])


@query("j6_centroid_label", "areas", "facilities", sql="SELECT DISTINCT a.id, f.id AS facility FROM areas a, facilities f WHERE a.x + 0.02 >= f.x - f.r AND a.x + 0.02 < f.x + f.r AND a.y + 0.08 >= f.y - f.r AND a.y + 0.08 < f.y + f.r")
def _(areas, facilities):
    areas = areas.repartition(int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # measures of rings are dear, a small file is one task
    centre = areas.select("id", overlay.ring_measures(kite(F.col("x"), F.col("y"), F.lit(0.3))).alias("m")).select("id", r("m.cx").alias("px"), r("m.cy").alias("py"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("r")).alias("x"), (F.col("y") + dy * F.col("r")).alias("y"))
    squares = facilities.select(F.col("id").alias("facility"), F.array(*[corner(*d) for d in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]).alias("ring"))
    found = spatial.points_in_polygons(centre, squares, "px", "py", "ring", 5.0).select("id", "facility")
    once = lambda df: df.groupBy(df.columns[0]).count().where("count > 1").isEmpty()
    return found if once(areas.select("id")) and once(squares.select("facility")) else found.distinct()  # a pair is found once where ids are unique


def lines_and_squares(areas, facilities):
    lines = areas.select(F.col("id").alias("segment"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 3.1).alias("x1"), (F.col("y") + 1.7).alias("y1"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("r")).alias("x"), (F.col("y") + dy * F.col("r")).alias("y"))
    squares = facilities.select(F.col("id").alias("polygon"), F.array(*[corner(*d) for d in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]).alias("ring"))
    return overlay.segments_over_polygons(lines, squares, 5.0)


CLIP = "SELECT a.id AS segment, f.id AS polygon, greatest(0, (f.x - f.r - a.x) / 3.1, (f.y - f.r - a.y) / 1.7) AS t0, least(1, (f.x + f.r - a.x) / 3.1, (f.y + f.r - a.y) / 1.7) AS t1 FROM areas a, facilities f"


@query("j7_lines_in_polygons", "areas", "facilities", sql=f"SELECT polygon, count(*) AS n FROM ({CLIP}) WHERE t0 <= t1 GROUP BY polygon")
def _(areas, facilities):
    return lines_and_squares(areas, facilities).groupBy("polygon").agg(F.count("*").alias("n"))


@query("j8_clipped_length", "areas", "facilities", sql=f"SELECT polygon, round(sum((t1 - t0) * sqrt(3.1 * 3.1 + 1.7 * 1.7)), 5) AS length, round(sum((t1 - t0) * sqrt(3.1 * 3.1 + 1.7 * 1.7)) / max(4 * r * r), 5) AS density FROM ({CLIP}) JOIN facilities ON polygon = id WHERE t0 <= t1 GROUP BY polygon")
def _(areas, facilities):
    lengths = lines_and_squares(areas, facilities).groupBy("polygon").agg(F.sum("inside").alias("length"))
    sized = lengths.join(facilities.select(F.col("id").alias("polygon"), "r"), "polygon")
    return sized.select("polygon", r("length", 5).alias("length"), r(F.col("length") / (4 * F.col("r") * F.col("r")), 5).alias("density"))


@query("j11_knn_weights", "areas", sql=f"SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 6) AS w FROM ({KNN}) WHERE rnk <= 8")
def _(areas):
    edges = spatial.knn(areas, 8, 12.0, ("state",)).select("src", "dst")
    return edges.join(edges.groupBy("src").agg(r(1.0 / F.count("*")).alias("w")), "src")


def cells(areas):
    """A unit square for each area but every seventh, on a grid 40 wide."""
    east, north = (F.col("id") % 40).cast("double"), F.floor(F.col("id") / 40).cast("double")
    corner = lambda dx, dy: F.struct((east + dx).alias("x"), (north + dy).alias("y"))
    ring = F.array(*[corner(*d) for d in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return areas.select("id", "balance", "jobs", F.when(F.col("id") % 7 != 0, ring).alias("ring"))


QUEEN = "SELECT a.id AS src, b.id AS dst FROM areas a JOIN areas b ON a.id <> b.id AND abs(a.id % 40 - b.id % 40) <= 1 AND abs(a.id // 40 - b.id // 40) <= 1 AND a.id % 7 <> 0 AND b.id % 7 <> 0"


@query("j12_queen_contiguity", "areas", sql=QUEEN)
def _(areas):
    return overlay.queen_contiguity(cells(areas))


@query("g2_degrees", "areas", sql=f"SELECT degree, count(*) AS n FROM (SELECT id, count(dst) AS degree FROM areas LEFT JOIN ({QUEEN}) ON src = id GROUP BY id) GROUP BY degree")
def _(areas):
    degrees = overlay.queen_contiguity(cells(areas)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return areas.select("id").join(degrees, "id", "left").groupBy(F.coalesce("degree", F.lit(0).cast("long")).alias("degree")).agg(F.count("*").alias("n"))


@query("g3_neighbour_means", "areas", sql=f"SELECT src AS id, count(*) AS n, round(avg(balance), 5) AS mean FROM ({QUEEN}) JOIN areas ON id = dst GROUP BY src")
def _(areas):
    layer = cells(areas)
    values = layer.select(F.col("id").alias("dst"), "balance")
    return overlay.queen_contiguity(layer).join(values, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), r(F.avg("balance"), 5).alias("mean"))


@query("l11_neighbourhood", "areas", sql=f"SELECT a.id, count(src) AS n, round(coalesce(avg(b.balance), max(a.balance)), 5) AS smooth, count(src) = 0 AS island FROM areas a LEFT JOIN ({QUEEN}) ON src = a.id LEFT JOIN areas b ON b.id = dst GROUP BY a.id")
def _(areas):
    layer = cells(areas)
    around = overlay.queen_contiguity(layer).join(layer.select(F.col("id").alias("dst"), "balance"), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.avg("balance").alias("m"))
    joined = layer.select("id", "balance").join(around, "id", "left")
    return joined.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), r(F.coalesce("m", "balance"), 5).alias("smooth"), F.col("n").isNull().alias("island"))


# Statistics and fits

RANKS = "SELECT city, rank() OVER (PARTITION BY city ORDER BY jobs) + (count(*) OVER (PARTITION BY city, jobs) - 1) / 2.0 AS a, rank() OVER (PARTITION BY city ORDER BY balance) + (count(*) OVER (PARTITION BY city, balance) - 1) / 2.0 AS b, rank() OVER (PARTITION BY city ORDER BY population) + (count(*) OVER (PARTITION BY city, population) - 1) / 2.0 AS c FROM areas"


@query("t3_mean_spearman", "areas", sql=f"SELECT round(avg(ab), 5) AS jobs_balance, round(avg(ac), 5) AS jobs_population, round(avg(bc), 5) AS balance_population FROM (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM ({RANKS}) GROUP BY city)")
def _(areas):
    names = ("jobs", "balance", "population")
    ranked = ranks.mean_ranks(areas.select("city", *names), ["city"], {c: f"r_{c}" for c in names}).select("city", *[F.col(f"r_{c}").alias(c) for c in names])
    pairs = (("jobs", "balance"), ("jobs", "population"), ("balance", "population"))
    cities = ranked.groupBy("city").agg(*[scores.safe_corr(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    return cities.agg(*[r(F.avg(f"{a}_{b}"), 5).alias(f"{a}_{b}") for a, b in pairs])


@query("t6_vif", "areas", sql="WITH c AS (SELECT corr(jobs, balance) AS a, corr(jobs, population) AS b, corr(balance, population) AS c FROM areas), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c) SELECT 'jobs' AS predictor, round((1 - c * c) / det, 5) AS vif FROM d UNION ALL SELECT 'balance', round((1 - b * b) / det, 5) FROM d UNION ALL SELECT 'population', round((1 - a * a) / det, 5) FROM d")
def _(areas):
    names = ["jobs", "balance", "population"]
    found = regression.inflation(areas, names)
    return found.select("predictor", r("vif", 5).alias("vif"))


@query("m3_fold_scaling", "areas", sql="WITH s AS (SELECT city, count(*) AS n, sum(jobs) AS x, sum(jobs * jobs) AS xx FROM areas GROUP BY city), t AS (SELECT city, (sum(n) OVER () - n) AS n, (sum(x) OVER () - x) AS x, (sum(xx) OVER () - xx) AS xx FROM s) SELECT geoid, round((jobs - t.x / n) / sqrt(xx / n - (t.x / n) * (t.x / n)), 5) AS z FROM areas JOIN t USING (city)")
def _(areas):
    own = areas.groupBy("city").agg(F.count("*").alias("n"), F.sum("jobs").alias("x"), F.sum(F.col("jobs") * F.col("jobs")).alias("xx"))
    total = own.agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "x", "xx")])
    rest = own.crossJoin(F.broadcast(total)).select("city", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("n", "x", "xx")])  # one row
    mean = F.try_divide("x", "n")
    sd = F.sqrt(F.greatest(F.try_divide("xx", "n") - mean * mean, F.lit(0.0)))
    rest = rest.select("city", mean.alias("mean"), F.when(sd < 1e-12, 1.0).otherwise(sd).alias("sd"))
    return areas.join(rest, "city").select("geoid", r((F.col("jobs") - F.col("mean")) / F.col("sd"), 5).alias("z"))


@query("m6_within", "areas", sql="WITH z AS (SELECT jobs - avg(jobs) OVER (PARTITION BY city) AS x, (balance - avg(balance) OVER (PARTITION BY city)) / stddev_samp(balance) OVER (PARTITION BY city) AS y FROM areas) SELECT round(sum(x * y) / sum(x * x), 8) AS slope FROM z")
def _(areas):
    # Sums by city are enough: no row is moved.
    cross = F.covar_pop("jobs", "balance") * F.count("*") / F.nullif(F.stddev_samp("balance"), F.lit(0.0))
    cities = areas.groupBy("city").agg(cross.alias("xy"), (F.var_pop("jobs") * F.count("*")).alias("xx"))
    return cities.agg(r(F.try_divide(F.sum("xy"), F.sum("xx")), 8).alias("slope"))


WEIGHTED = "SELECT sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM (SELECT population AS w, ln(1 + jobs) AS x, ln(1 + 1000.0 * jobs / population) AS y FROM areas WHERE population > 0)"


@query("m10_weighted_ridge", "areas", sql=f"SELECT alpha, round((xy / w - x * y / w / w) / ((xx / w - x * x / w / w) * (1 + alpha / w)), 6) AS coef, round(y / w - (xy / w - x * y / w / w) / ((xx / w - x * x / w / w) * (1 + alpha / w)) * x / w, 6) AS intercept FROM ({WEIGHTED}), (SELECT unnest([0.1, 1.0, 10.0])::double AS alpha)")
def _(areas):
    rows = areas.where("population > 0").select(F.col("population").cast("double").alias("w"), F.log1p("jobs").alias("x"), F.log1p(C.rate(F.col("jobs"), F.col("population"))).alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    m = rows.agg(F.sum("w").alias("n"), (F.sum(w * x) / F.sum("w")).alias("mx"), (F.sum(w * y) / F.sum("w")).alias("my"), (F.sum(w * x * x) / F.sum("w")).alias("mxx"), (F.sum(w * x * y) / F.sum("w")).alias("mxy"))
    fits = m.withColumn("alpha", F.explode(F.array(F.lit(0.1), F.lit(1.0), F.lit(10.0))))
    coef = F.try_divide(F.col("mxy") - F.col("mx") * F.col("my"), (F.col("mxx") - F.col("mx") * F.col("mx")) * (1 + F.col("alpha") / F.col("n")))
    return fits.withColumn("c", coef).select("alpha", r("c").alias("coef"), r(F.col("my") - F.col("c") * F.col("mx")).alias("intercept"))


@query("m11_repeated_splits", "areas", sql="WITH s AS (SELECT seed, (id * 7919 + seed * 104729) % 4 = 0 AS test, jobs + 0.0 AS x, balance AS y FROM areas, (SELECT unnest(range(0, 6)) AS seed)), f AS (SELECT seed, regr_slope(y, x) FILTER (NOT test) AS b, regr_intercept(y, x) FILTER (NOT test) AS a FROM s GROUP BY seed), e AS (SELECT s.seed, 1 - sum(pow(y - a - b * x, 2)) / (var_pop(y) * count(*)) AS r2 FROM s JOIN f USING (seed) WHERE test GROUP BY s.seed) SELECT round(avg(r2), 6) AS mean, round(stddev_samp(r2), 6) AS sd, count(*) AS splits FROM e")
def _(areas):
    split = areas.select("id", F.col("jobs").cast("double").alias("x"), F.col("balance").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seed"))
    test = (F.col("id") * 7919 + F.col("seed") * 104729) % 4 == 0
    on = lambda yes, c: F.when(test if yes else ~test, c)
    x, y = F.col("x"), F.col("y")
    names = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    sums = split.groupBy("seed").agg(F.regr_slope(on(False, y), x).alias("b"), F.regr_intercept(on(False, y), x).alias("a"), *[F.sum(on(True, c)).alias(k) for k, c in names.items()])
    errors = F.expr("yy - 2 * a * y - 2 * b * xy + a * a * n + 2 * a * b * x + b * b * xx")
    scored = sums.select((1 - F.try_divide(errors, F.expr("yy - y * y / n"))).alias("r2"))
    return scored.agg(r(F.avg("r2")).alias("mean"), r(F.stddev_samp("r2")).alias("sd"), F.count("*").alias("splits"))


@query("m12_weighted_folds", "areas", sql="WITH t AS (SELECT id % 5 AS k, population + 0.0 AS w, jobs + 0.0 AS x, balance AS y FROM areas), g AS (SELECT k, sum(w) w, sum(w * x) x, sum(w * y) y, sum(w * x * x) xx, sum(w * x * y) xy FROM t GROUP BY k), o AS (SELECT a.k, sum(b.w) w, sum(b.x) x, sum(b.y) y, sum(b.xx) xx, sum(b.xy) xy FROM g a JOIN g b ON a.k <> b.k GROUP BY a.k), f AS (SELECT k, (w * xy - x * y) / (w * xx - x * x) AS b, (y - (w * xy - x * y) / (w * xx - x * x) * x) / w AS a FROM o), m AS (SELECT sum(w * y) / sum(w) AS my FROM t) SELECT round(1 - sum(t.w * pow(t.y - a - b * t.x, 2)) / sum(t.w * pow(t.y - my, 2)), 6) AS r2 FROM t JOIN f USING (k), m")
def _(areas):
    rows = areas.select((F.col("id") % 5).alias("k"), F.col("population").cast("double").alias("w"), F.col("jobs").cast("double").alias("x"), F.col("balance").alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    names = {"w": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y, "yy": w * y * y}
    folds = rows.groupBy("k").agg(*[F.sum(c).alias(f"s_{n}") for n, c in names.items()])
    total = folds.agg(*[F.sum(f"s_{n}").alias(f"t_{n}") for n in names])
    both = folds.crossJoin(F.broadcast(total)).withColumns({f"r_{n}": F.col(f"t_{n}") - F.col(f"s_{n}") for n in names})  # one row
    both = both.withColumn("b", F.expr("try_divide(r_w * r_xy - r_x * r_y, r_w * r_xx - r_x * r_x)")).withColumn("a", F.expr("try_divide(r_y - b * r_x, r_w)"))
    errors = F.sum(F.expr("s_yy - 2 * a * s_y - 2 * b * s_xy + a * a * s_w + 2 * a * b * s_x + b * b * s_xx"))
    return both.agg(r(1 - F.try_divide(errors, F.max(F.expr("t_yy - t_y * t_y / t_w")))).alias("r2"))


@query("m13_stored_coefficients", "areas", sql="SELECT geoid, round(exp(0.4 + 0.001 * jobs + 0.0002 * population) - 1, 5) AS rate FROM areas WHERE population > 0 AND jobs IS NOT NULL")
def _(areas):
    stored = {"jobs": 0.001, "population": 0.0002}
    usable = areas.withColumn("population", F.when(F.col("population") > 0, F.col("population"))).dropna(subset=list(stored))
    return usable.select("geoid", r(F.expm1(sum((F.col(c) * b for c, b in stored.items()), F.lit(0.4))), 5).alias("rate"))


@query("m8_cross_validation", "areas", sql=f"SELECT geoid, 'ridge' AS estimator, round(a + b * jobs, 3) AS y_pred FROM areas JOIN ({FITS}) USING (city) UNION ALL SELECT geoid, 'mean', round((sum(balance) OVER () - sum(balance) OVER (PARTITION BY city)) / (count(*) OVER () - count(*) OVER (PARTITION BY city)), 3) FROM areas")
def _(areas):
    fitted = regression.loco_ridge(areas, ["jobs"], "balance", "city").select("geoid", F.lit("ridge").alias("estimator"), "y_pred")
    flat = regression.loco_ridge(areas, [], "balance", "city").select("geoid", F.lit("mean").alias("estimator"), "y_pred")
    return fitted.unionByName(flat).withColumn("y_pred", r("y_pred", 3))


# Scores

RUN = "SELECT city, geoid, population AS w, balance AS y, 0.9 * balance + jobs AS p, population + 0.0 AS q FROM areas"
RANKED = ", ".join(f"(rank() OVER (PARTITION BY city ORDER BY {c}) + (count(*) OVER (PARTITION BY city, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY city) AS r{c}" for c in "ypq")
CARD = "SELECT city, n, round(r2, 5) AS r2, round(rho, 5) AS rho, round(mae, 4) AS mae, round(recall10, 6) AS recall10, round(recall25, 6) AS recall25, round(called_safe, 6) AS called_safe FROM "


def card(p: str, by: str) -> str:
    rec = lambda low: f"count(*) FILTER (round(ry, 9) >= {low} AND round(r{p}, 9) >= {low}) / nullif(count(*) FILTER (round(ry, 9) >= {low}), 0)"
    return f"(SELECT {by} AS city, count(*) AS n, 1 - sum(pow(y - {p}, 2)) / nullif(var_pop(y) * count(*), 0) AS r2, corr(ry, r{p}) AS rho, avg(abs(y - {p})) AS mae, {rec(0.9)} AS recall10, {rec(0.75)} AS recall25, count(*) FILTER (round(ry, 9) >= 0.9 AND round(r{p}, 9) <= 0.5) / nullif(count(*) FILTER (round(ry, 9) >= 0.9), 0) AS called_safe FROM (SELECT *, {RANKED} FROM ({RUN})) {'' if by.startswith(chr(39)) else 'GROUP BY city'})"


def run(areas, incumbent: bool = False):
    p = F.col("population").cast("double") if incumbent else 0.9 * F.col("balance") + F.col("jobs")
    return scores.ranked(areas.select("city", "geoid", F.col("population").alias("w"), F.col("balance").alias("y"), p.alias("p")), "city")


def rounded(table, *keys):
    digits = {"r2": 5, "rho": 5, "mae": 4, "recall10": 6, "recall25": 6, "called_safe": 6}
    return table.select(*keys, "n", *[r(c, d).alias(c) for c, d in digits.items()])


@query("e4_scorecard", "areas", sql=f"SELECT round(a.r2, 5) AS r2, round(a.mae, 4) AS mae, round(a.recall10, 6) AS recall10, round(a.recall25, 6) AS recall25, round(a.called_safe, 6) AS called_safe, round(avg(c.r2), 5) AS r2_city, round(avg(c.rho), 5) AS rho_city, round(avg(c.recall10), 6) AS recall10_city, round(avg(c.recall25), 6) AS recall25_city FROM {card('p', chr(39) + 'all' + chr(39))} a, {card('p', 'city')} c GROUP BY a.r2, a.mae, a.recall10, a.recall25, a.called_safe")
def _(areas):
    ranked = run(areas)
    cities = scores.scorecard(ranked, ["city"]).agg(r(F.avg("r2"), 5).alias("r2_city"), r(F.avg("rho"), 5).alias("rho_city"), r(F.avg("recall10")).alias("recall10_city"), r(F.avg("recall25")).alias("recall25_city"))
    return rounded(scores.scorecard(ranked, [])).drop("n", "rho").crossJoin(F.broadcast(cities))  # one row each


@query("e5_city_scorecard", "areas", sql=CARD + card("p", "city"))
def _(areas):
    return rounded(scores.scorecard(run(areas), ["city"]), "city")


@query("f21_adjusted_r2", "areas", sql="SELECT state, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted FROM (SELECT state, regr_r2(balance, jobs) AS r2, count(*) AS n FROM areas GROUP BY state)")
def _(areas):
    fits = areas.groupBy("state").agg(F.regr_r2("balance", "jobs").alias("r2"), F.count("*").alias("n"))
    return fits.select("state", r(1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("n") - 2)).alias("adjusted"))


@query("e9_compare_runs", "areas", sql=f"SELECT 'model' AS run, round(avg(r2), 5) AS r2, round(avg(rho), 5) AS rho, round(avg(mae), 4) AS mae FROM {card('p', 'city')} UNION ALL SELECT 'incumbent', round(avg(r2), 5), round(avg(rho), 5), round(avg(mae), 4) FROM {card('q', 'city')}")
def _(areas):
    both = [scores.scorecard(run(areas, old), ["city"]).agg(r(F.avg("r2"), 5).alias("r2"), r(F.avg("rho"), 5).alias("rho"), r(F.avg("mae"), 4).alias("mae")).withColumn("run", F.lit(name)) for name, old in (("model", False), ("incumbent", True))]
    return both[0].unionByName(both[1])


@query("e11_weighted_rescoring", "areas", sql="WITH t AS (SELECT population AS w, exp(ln(1 + jobs)) - 1 AS y, exp(ln(1 + population / 5.0)) - 1 AS p FROM areas), m AS (SELECT sum(w * y) / sum(w) AS my FROM t) SELECT round(1 - sum(w * pow(y - p, 2)) / sum(w * pow(y - my, 2)), 6) AS r2, round(sum(w * abs(y - p)) / sum(w), 4) AS mae FROM t, m")
def _(areas):
    logs = areas.select(F.col("population").alias("w"), F.log1p("jobs").alias("ly"), F.log1p(F.col("population") / 5.0).alias("lp"))
    rates = logs.select("w", F.expm1("ly").alias("y"), F.expm1("lp").alias("p"))
    w, y, p = F.col("w"), F.col("y"), F.col("p")
    spread = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum("w")
    return rates.agg(r(1 - F.try_divide(F.sum(w * F.pow(y - p, F.lit(2))), spread)).alias("r2"), r(F.try_divide(F.sum(w * F.abs(y - p)), F.sum("w")), 4).alias("mae"))


DIAGNOSIS = f"SELECT city, round(avg(p - y), 4) AS level_error, round(1 - sum(pow(y - p + s, 2)) / (var_pop(y) * count(*)), 5) AS levelled, round(corr(y, p), 5) AS within FROM (SELECT *, avg(p - y) OVER (PARTITION BY city) AS s FROM ({RUN})) GROUP BY city"


@query("e12_diagnosis", "areas", sql=DIAGNOSIS)
def _(areas):
    e = F.col("p") - F.col("y")
    return run(areas).groupBy("city").agg(r(F.avg(e), 4).alias("level_error"), r(1 - F.try_divide(F.var_pop(e), F.var_pop("y")), 5).alias("levelled"), r(scores.safe_corr(F.col("y"), F.col("p")), 5).alias("within"))


PAIRED = f"SELECT city, a.rho - b.rho AS gain_rho, a.mae - b.mae AS gain_mae FROM {card('p', 'city')} a JOIN {card('q', 'city')} b USING (city)"


def paired(areas):
    sides = [scores.scorecard(run(areas, old), ["city"]).select("city", F.col("rho").alias(f"rho_{k}"), F.col("mae").alias(f"mae_{k}")) for k, old in (("a", False), ("b", True))]
    return sides[0].join(sides[1], "city").select("city", (F.col("rho_a") - F.col("rho_b")).alias("gain_rho"), (F.col("mae_a") - F.col("mae_b")).alias("gain_mae"))


@query("e13_against_incumbent", "areas", sql=f"SELECT city, round(gain_rho, 5) AS gain_rho, round(gain_mae, 3) AS gain_mae, level_error FROM ({PAIRED}) JOIN ({DIAGNOSIS}) USING (city)")
def _(areas):
    levels = run(areas).groupBy("city").agg(r(F.avg(F.col("p") - F.col("y")), 4).alias("level_error"))
    return paired(areas).join(levels, "city").select("city", r("gain_rho", 5).alias("gain_rho"), r("gain_mae", 3).alias("gain_mae"), "level_error")


@query("k1_run_score", "areas", sql=f"SELECT round(avg(r2), 5) AS city_mean, max(pooled) AS pooled FROM {card('p', 'city')}, (SELECT round(r2, 5) AS pooled FROM {card('p', chr(39) + 'all' + chr(39))})")
def _(areas):
    ranked = run(areas)
    mean = scores.scorecard(ranked, ["city"]).agg(r(F.avg("r2"), 5).alias("city_mean"))
    return mean.crossJoin(F.broadcast(scores.scorecard(ranked, []).select(r("r2", 5).alias("pooled"))))  # one row


# Attribution and levels


@query("h2_sign_stability", "areas", sql=f"SELECT round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS sd, round(greatest(count(*) FILTER (b > 0), count(*) FILTER (b < 0)) / count(*), 6) AS one_sign FROM ({FITS})")
def _(areas):
    fits = regression.loco_coefficients(areas, ["jobs"], "balance", "city")
    return fits.agg(r(F.avg("_b1")).alias("mean"), r(F.stddev_samp("_b1")).alias("sd"), r(F.greatest(F.count_if(F.col("_b1") > 0), F.count_if(F.col("_b1") < 0)) / F.count("*")).alias("one_sign"))


@query("l3_relevel", "areas", sql="WITH c AS (SELECT city, avg(jobs) AS m, CASE WHEN city % 4 <> 0 THEN 100.0 + city END AS level FROM areas GROUP BY city) SELECT geoid, round(CASE WHEN level / m > 0 THEN jobs * pow(level / m, 0.5) ELSE jobs END, 5) AS p FROM areas JOIN c USING (city)")
def _(areas):
    anchors = areas.select("city").distinct().where("city % 4 <> 0").withColumn("level", F.lit(100.0) + F.col("city"))
    return scores.relevel(areas.select("city", "geoid", F.col("jobs").cast("double").alias("p")), anchors, 0.5).select("geoid", r("p", 5).alias("p"))


@query("l4_lagged_anchor", "incidents", sql="WITH y AS (SELECT area_id % 25 AS city, year(occurred) AS year, count(*) AS n FROM incidents GROUP BY 1, 2) SELECT a.city, a.year, a.n AS level, b.n AS lagged FROM y a LEFT JOIN y b ON a.city = b.city AND b.year = a.year - 1")
def _(incidents):
    years = incidents.groupBy((F.col("area_id") % 25).alias("city"), F.year("occurred").cast("long").alias("year")).agg(F.count("*").alias("level"))
    before = years.select("city", (F.col("year") + 1).alias("year"), F.col("level").alias("lagged"))
    return years.join(before, ["city", "year"], "left")


@query("l5_incumbent_run", "areas", sql="SELECT geoid, round(ln(1 + jobs), 6) AS y, round(ln(1 + 1000.0 * jobs / population), 6) AS y_pred FROM areas WHERE population >= 250")
def _(areas):
    return areas.where("population >= 250").select("geoid", r(F.log1p("jobs")).alias("y"), r(F.log1p(C.rate(F.col("jobs"), F.col("population")))).alias("y_pred"))


TARGET = "SELECT a.geoid, count(i.id) AS n, round(1000.0 * count(i.id) / nullif(max(a.population), 0), 5) AS rate FROM areas a LEFT JOIN incidents i ON i.area_id = a.id AND i.x IS NOT NULL AND i.code <> '5-LOW' AND i.occurred >= TIMESTAMP '1995-01-01' GROUP BY a.geoid"


def target(incidents, areas):
    """Incidents with a place and a mapped code since a date, by area, with their rate; areas without any have 0."""
    counts = incidents.where("x is not null and code <> '5-LOW' and occurred >= timestamp '1995-01-01'").groupBy(F.col("area_id").alias("id")).agg(F.count("*").alias("n"))
    return areas.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("rate", C.rate(F.col("n"), F.col("population")))


@query("l6_target", "incidents", "areas", sql=TARGET)
def _(incidents, areas):
    return target(incidents, areas).select("geoid", "n", r("rate", 5).alias("rate"))


@query("l7_model_table", "incidents", "areas", sql=f"WITH m AS (SELECT city, median(nullif(population, 0)) AS mid FROM areas GROUP BY city) SELECT geoid, round(ln(1 + coalesce(nullif(population, 0), mid)), 6) AS log_population, cast(state = 1 AS integer) AS state_1, cast(state = 2 AS integer) AS state_2, round(ln(1 + rate), 5) AS target FROM areas JOIN m USING (city) JOIN ({TARGET}) USING (geoid)")
def _(incidents, areas):
    table = target(incidents, areas)
    known = F.when(F.col("population") != 0, F.col("population"))
    middle = ranks.medians(areas.select("city", known.alias("known")), ["city"], "known", "mid")
    filled = join_keyed(table, middle, ["city"], "left").withColumn("filled", F.coalesce(known.cast("double"), "mid"))
    return filled.select("geoid", r(F.log1p("filled")).alias("log_population"), *[(F.col("state") == k).cast("int").alias(f"state_{k}") for k in (1, 2)], r(F.log1p(r("rate", 5)), 5).alias("target"))


@query("l13_agency_roll_up", "exposures", sql="SELECT agency, round(sum(price * exposure) / sum(exposure), 3) AS price, round(ln(1 + sum(exposure)), 6) AS log_exposure, count(DISTINCT id) AS orders FROM exposures GROUP BY agency")
def _(exposures):
    w = F.col("exposure")
    return exposures.groupBy("agency").agg(r(F.try_divide(F.sum(F.col("price") * w), F.sum(w)), 3).alias("price"), r(F.log1p(F.sum(w))).alias("log_exposure"), F.count_distinct("id").alias("orders"))
