"""Queries of the inventory's remaining rows: audits, shares, functions, agency selection, comparisons of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealens.operators import aggregates, attribution, curves, overlay, ranks, regression, scores, selection, targets, trees
from arealens.plans.choices import FIT, ORACLES, QUERIES, STUMPS, Y, fitted, query, r
from arealens.scratch import stage

__all__ = ["ORACLES", "QUERIES"]


@query("s15_key_audit", "incidents", sql="SELECT length(geoid) AS length, count(*) AS n, count(*) - count(DISTINCT geoid) AS repeated FROM incidents GROUP BY 1")
def _(incidents):
    keys = incidents.groupBy("geoid").agg(F.count("*").alias("n"))
    return keys.groupBy(F.length("geoid").cast("long").alias("length")).agg(F.sum("n").alias("n"), (F.sum("n") - F.count("*")).alias("repeated"))


@query("p17_scopes", "areas", sql="SELECT scope, count(*) AS n, cast(sum(population) AS bigint) AS people FROM (SELECT unnest(CASE WHEN city < 10 THEN ['all', 'inside'] ELSE ['all', 'outside'] END) AS scope, population FROM areas) GROUP BY scope")
def _(areas):
    scope = F.explode(F.array(F.lit("all"), F.when(F.col("city") < 10, "inside").otherwise("outside")))
    return areas.select(scope.alias("scope"), "population").groupBy("scope").agg(F.count("*").alias("n"), F.sum("population").alias("people"))


@query("a25_percentile_table", "areas", sql="SELECT p, round(q, 4) AS value, (SELECT count(*) FROM areas WHERE balance >= q) AS at_least FROM (SELECT unnest([5, 25, 50, 75, 95]) AS p, unnest(quantile_cont(balance, [0.05, 0.25, 0.5, 0.75, 0.95])) AS q FROM areas)")
def _(areas):
    shares = [5, 25, 50, 75, 95]
    table = ranks.quantiles(areas, [], ["balance"], [p / 100 for p in shares]).select(F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("p"), "q")).alias("z")).select("z.p", F.col("z.q").alias("value"))
    counted = areas.select("balance").crossJoin(F.broadcast(table.agg(F.collect_list(F.struct("p", "value")).alias("t"))))  # one row
    cells = counted.agg(*[F.count_if(F.col("balance") >= F.col("t")[i]["value"]).alias(f"n{i}") for i in range(len(shares))])
    return table.crossJoin(F.broadcast(cells)).select("p", r("value", 4).alias("value"), F.element_at(F.array(*[F.col(f"n{i}") for i in range(len(shares))]), F.array_position(F.array(*map(F.lit, shares)), F.col("p")).cast("int")).alias("at_least"))


@query("w8_share_needed", "incidents", sql="WITH a AS (SELECT area_id, cast(sum(amount * 100) AS bigint) AS v FROM incidents GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY v DESC, area_id) AS k, count(*) OVER () AS n, sum(v) OVER (ORDER BY v DESC, area_id ROWS UNBOUNDED PRECEDING) AS cum, sum(v) OVER () AS total FROM a) SELECT goal, round(100.0 * min(k) / max(n), 6) AS top_pct FROM o, unnest([50, 80]) AS t(goal) WHERE 100 * cum >= goal * total GROUP BY goal")
def _(incidents):
    sums = incidents.groupBy("area_id").agg(F.round(F.sum(F.col("amount") * 100).cast("decimal(38,6)")).cast("long").alias("v"))
    return curves.share_needed(sums, "v", "area_id", [50, 80]).withColumn("top_pct", r("top_pct"))


@query("l16_score_comparison", "exposures", sql="""WITH m AS (SELECT carrier, name, CASE name WHEN 'price' THEN price WHEN 'part' THEN part + 0.0 ELSE agency + 0.0 END AS score, exposure, claims, id * 8 + line AS key FROM exposures, (SELECT unnest(['price', 'part', 'agency']) AS name) WHERE exposure > 0 AND part % 10 < 7),
    c AS (SELECT carrier, name, sum(exposure) OVER w / sum(exposure) OVER g AS x, sum(claims) OVER w / sum(claims) OVER g AS y, coalesce(sum(exposure) OVER v, 0) / sum(exposure) OVER g AS x0, coalesce(sum(claims) OVER v, 0) / sum(claims) OVER g AS y0 FROM m
        WINDOW g AS (PARTITION BY carrier, name), w AS (PARTITION BY carrier, name ORDER BY score DESC, key ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY carrier, name ORDER BY score DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT carrier, name AS score, round(sum((x - x0) * (y + y0)) - 1, 6) AS gini FROM c GROUP BY carrier, name""")
def _(exposures):
    segment = exposures.where("exposure > 0 and part % 10 < 7").withColumn("key", F.col("id") * 8 + F.col("line"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("price", "part", "agency")]))
    melted = segment.select("carrier", "exposure", "claims", "key", cells.alias("s")).select("carrier", "exposure", "claims", "key", "s.name", "s.value")
    curve = curves.lorenz(melted, "value", "claims", "exposure", ["carrier", "name"], "key")
    return curves.gini(curve, ["carrier", "name"]).select("carrier", F.col("name").alias("score"), r("gini").alias("gini"))


SEVERITY = {"1-URGENT": "a", "2-HIGH": "b", "3-MEDIUM": "c"}
SEVERITY_SQL = """WITH y AS (SELECT area_id % 25 AS city, year(occurred) AS yr, count(*) FILTER (code = '1-URGENT') AS a, count(*) FILTER (code = '2-HIGH') AS b, count(*) FILTER (code = '3-MEDIUM') AS c FROM incidents GROUP BY 1, 2),
    p AS (SELECT city, greatest(a * (1 + (yr - 1998) * (city - 12) / 40.0), 0) AS a, greatest(b * (1 + (yr - 1998) * (city - 12) / 40.0), 0) AS b, CASE WHEN city <> 7 THEN greatest(c * (1 + (yr - 1998) * (city - 12) / 40.0), 0) END AS c FROM y),
    m AS (SELECT city, max(a) AS a, max(b) AS b, max(c) AS c FROM p GROUP BY city), u AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM m)
    SELECT city, round((m.a / u.a / 3 + m.b / u.b / 3 + m.c / u.c / 3) * (u.a + u.b), 5) AS weighted FROM m, u"""


@query("f20_severity_weighted_rate", "incidents", sql=SEVERITY_SQL)
def _(incidents):
    years = incidents.groupBy((F.col("area_id") % 25).alias("city"), F.year("occurred").alias("yr")).agg(*[F.count_if(F.col("code") == code).alias(n) for code, n in SEVERITY.items()])
    change = (F.col("city") - 12) / 40.0
    rated = years.withColumn("c", F.when(F.col("city") != 7, F.col("c")))  # a city that does not report one kind has no total
    found = aggregates.severity_weighted(rated, "city", "yr", list(SEVERITY.values()), change, 1998, level=["a", "b"])
    return found.select("city", r("weighted", 5).alias("weighted"))


@query("f30_text_functions", "part", sql="SELECT p_partkey, upper(trim(p_name)) AS a, substr(p_name, 3, 4) AS b, p_name LIKE '%e%' AS c, regexp_extract(p_brand, '#([0-9])', 1) AS d, string_split(p_name, ' ')[1] AS e, lpad(cast(p_partkey AS varchar), 9, '0') AS f, replace(p_name, ' ', '_') AS g, length(p_name) AS h, lower(p_brand) AS i FROM part")
def _(part):
    n, b = F.col("p_name"), F.col("p_brand")
    return part.select("p_partkey", F.upper(F.trim(n)).alias("a"), F.substring(n, 3, 4).alias("b"), n.like("%e%").alias("c"), F.regexp_extract(b, "#([0-9])", 1).alias("d"), F.split(n, " ")[0].alias("e"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("f"), F.replace(n, F.lit(" "), F.lit("_")).alias("g"), F.length(n).cast("long").alias("h"), F.lower(b).alias("i"))


@query("f34_number_functions", "areas", sql="SELECT geoid, round(ln(1 + jobs), 6) AS a, round(exp(jobs / 1000.0) - 1, 6) AS b, round(sqrt(population), 6) AS c, round(log10(1 + population), 6) AS d, round(pow(jobs, 1.5), 4) AS e, cast(sign(balance) AS integer) AS f, cast(ceil(balance) AS bigint) AS g, round(least(greatest(balance, -100), 5000), 2) AS h, round(radians(x), 8) AS i, round(sqrt(x * x + y * y), 6) AS j FROM areas")
def _(areas):
    c = F.col
    return areas.select(
        "geoid", r(F.log1p("jobs")).alias("a"), r(F.expm1(c("jobs") / 1000.0)).alias("b"), r(F.sqrt("population")).alias("c"), r(F.log10(1 + c("population"))).alias("d"), r(F.pow("jobs", F.lit(1.5)), 4).alias("e"),
        F.sign("balance").cast("int").alias("f"), F.ceil("balance").cast("long").alias("g"), r(F.least(F.greatest("balance", F.lit(-100.0)), F.lit(5000.0)), 2).alias("h"), r(F.radians("x"), 8).alias("i"), r(F.hypot("x", "y")).alias("j"),
    )


@query("f35_array_functions", "part", sql="WITH w AS (SELECT p_size, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT p_size, count(*) AS words, count(DISTINCT word) AS kinds, array_to_string(list_sort(list(DISTINCT word))[1:3], ',') AS first_three FROM w GROUP BY p_size")
def _(part):
    # Words are made distinct before they are gathered, so a group's list is no longer than its vocabulary.
    words = part.select("p_size", F.explode(F.split("p_name", " ")).alias("word")).groupBy("p_size", "word").agg(F.count("*").alias("n"))
    sets = words.groupBy("p_size").agg(F.sum("n").alias("words"), F.count("*").alias("kinds"), F.array_sort(F.collect_list("word")).alias("w"))
    return sets.select("p_size", "words", "kinds", F.array_join(F.slice("w", 1, 3), ",").alias("first_three"))


# Agencies: weighted selection on logs, scored on rates


def agencies(exposures):
    """One row an agency: its rate and weight, and predictors of which two carry the rate."""
    w = F.col("exposure")
    sums = exposures.groupBy("agency").agg(F.sum(w).alias("weight"), F.avg("price").alias("price"), F.avg(F.col("part") * 1.0).alias("part"), F.avg(F.col("claims") * w).alias("load"), F.stddev_samp("price").alias("spread"))
    return sums.withColumn("rate", F.col("price") / 1000 + F.col("load") / 4 + F.pmod(F.col("agency") * 7919, F.lit(13)) / 8)


@query("k5_weighted_stepwise", "exposures")
def _(exposures):
    """Held against a plain search in the tests; SQL has no loop for it."""
    found = selection.best_direction(agencies(exposures), ["price", "part", "load", "spread"], "rate", "weight", "agency")
    return found.history


@query("k6_nested_stepwise", "exposures")
def _(exposures):
    scores, chosen = selection.nested_selection(agencies(exposures), ["price", "part", "load"], "rate", "weight", "agency", seeds=(0, 1))
    return selection.selection_frequency(exposures.sparkSession, chosen)


@query("k7_constrained_tuning", "areas")
def _(areas):
    table = areas.withColumn("target", F.expr(Y))
    grid = [trees.TreeParams(trees=3, depth=1, rate=0.5, bins=8), trees.TreeParams(trees=2, depth=2, rate=0.5, bins=8)]
    _, trials = trees.tune(table, ["jobs", "population"], "target", "city", "id", grid, default=STUMPS)
    rows = [(k, p.trees, p.depth, p.rate, r2, recall, ok) for k, (p, r2, recall, ok) in enumerate(trials)]
    return areas.sparkSession.createDataFrame(rows, "trial int, trees int, depth int, rate double, r2 double, recall double, feasible boolean")


@query("m11_split_scores", "exposures")
def _(exposures):
    sets = {"two": ["price", "load"], "all": ["price", "part", "load", "spread"]}
    rows = selection.split_scores(agencies(exposures), sets, "rate", "weight", "agency", seeds=(0, 1, 2))
    return exposures.sparkSession.createDataFrame(rows, selection.SPLIT_SCORES)


def _lorenz_sql(score: str, name: str) -> str:
    return f"""{name}c AS (SELECT city, sum(w) OVER k / sum(w) OVER g AS x, sum(o) OVER k / sum(o) OVER g AS y, coalesce(sum(w) OVER v, 0) / sum(w) OVER g AS x0, coalesce(sum(o) OVER v, 0) / sum(o) OVER g AS y0 FROM t WINDOW g AS (PARTITION BY city), k AS (PARTITION BY city ORDER BY {score} DESC, id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY city ORDER BY {score} DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name}g AS (SELECT city, sum((x - x0) * (y + y0)) - 1 AS gini, max(CASE WHEN x0 < 0.2 AND x >= 0.2 THEN y0 + (y - y0) * (0.2 - x0) / (x - x0) END) AS capture FROM {name}c GROUP BY city)"""


FOLD_SQL = f"""WITH t AS (SELECT id, city, population AS w, jobs AS o, balance AS y, 0.9 * balance + jobs AS p, coalesce(jobs / nullif(population, 0), -1) AS d FROM areas), {_lorenz_sql('p', 'm')}, {_lorenz_sql('d', 'b')},
    f AS (SELECT a.city, 1 - (1 - regr_r2(b.balance, b.jobs)) * (count(*) - 1) / (count(*) - 2) AS adjusted FROM (SELECT DISTINCT city FROM areas) a JOIN areas b ON a.city <> b.city GROUP BY a.city),
    k AS (SELECT city, y, p, rank() OVER (PARTITION BY city ORDER BY y) + (count(*) OVER (PARTITION BY city, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY city ORDER BY p) + (count(*) OVER (PARTITION BY city, p) - 1) / 2.0 AS rp FROM t),
    e AS (SELECT city, count(*) AS n, corr(ry, rp) AS rho, avg(abs(y - p)) AS mae, sqrt(avg(pow(y - p, 2))) AS rmse, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM k GROUP BY city)
    SELECT e.city, n, round(mg.gini, 6) AS gini, round(bg.gini, 6) AS gini_oracle, round(mg.gini / bg.gini, 5) AS skill, round(mg.capture, 6) AS capture20, round(rho, 5) AS rho, round(r2, 5) AS r2, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(adjusted, 6) AS adjusted_in FROM e JOIN mg ON mg.city = e.city JOIN bg ON bg.city = e.city JOIN f ON f.city = e.city"""


@query("e6_fold_table", "areas", sql=FOLD_SQL)
def _(areas):
    rows = areas.select("id", "city", F.col("population").alias("w"), F.col("jobs").alias("o"), F.col("balance").alias("y"), (0.9 * F.col("balance") + F.col("jobs")).alias("p"), F.coalesce(F.try_divide("jobs", "population"), F.lit(-1.0)).alias("d"))
    model, best = (stage(curves.lorenz(rows, s, "o", "w", ["city"], "id"), "curve") for s in ("p", "d"))
    shapes = curves.gini(model, ["city"]).join(curves.capture_at(model, ["city"], 0.2), "city").join(curves.gini(best, ["city"]).withColumnRenamed("gini", "gini_oracle"), "city")
    fits = regression.rest_r2(areas, "jobs", "balance", "city").select("city", (1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("n") - 2)).alias("adjusted_in"))
    square = F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2)))
    errors = rows.groupBy("city").agg(F.sqrt(square).alias("rmse"))
    found = scores.scorecard(scores.ranked(rows.select("city", "id", "y", "p"), "city"), ["city"]).join(shapes, "city").join(fits, "city").join(errors, "city")
    digits = {"gini": 6, "gini_oracle": 6, "capture": 6, "rho": 5, "r2": 5, "rmse": 4, "mae": 4, "adjusted_in": 6}
    return found.select("city", "n", *[r(c, d).alias(c if c != "capture" else "capture20") for c, d in digits.items()], r(F.try_divide("gini", "gini_oracle"), 5).alias("skill"))


ROADS = "SELECT id AS segment, id % 9 AS class, x AS x0, y AS y0, x + 3.1 AS x1, y + 1.7 AS y1, id % 5 AS degree FROM areas"
_CLIPPED = "SELECT f.id AS polygon, s.*, greatest(0, (f.x - f.r - x0) / 3.1, (f.y - f.r - y0) / 1.7) AS t0, least(1, (f.x + f.r - x0) / 3.1, (f.y + f.r - y0) / 1.7) AS t1 FROM roads s, facilities f"
_SPOT = "least(greatest(((f.x - x0) * 3.1 + (f.y - y0) * 1.7) / (3.1 * 3.1 + 1.7 * 1.7), 0), 1)"
ROADWAY_SQL = f"""WITH roads AS ({ROADS}), c AS ({_CLIPPED}), far AS (SELECT f.id AS polygon, class, min(sqrt(pow(f.x - x0 - {_SPOT} * 3.1, 2) + pow(f.y - y0 - {_SPOT} * 1.7, 2))) AS d FROM roads, facilities f WHERE class IN (0, 1) GROUP BY 1, 2),
    n AS (SELECT f.id AS polygon, count(*) FILTER (degree >= 3) AS j, avg(cast(degree = 1 AS integer)) AS dead, avg(cast(degree = 4 AS integer)) AS four FROM roads JOIN facilities f ON x0 >= f.x - f.r AND x0 < f.x + f.r AND y0 >= f.y - f.r AND y0 < f.y + f.r GROUP BY f.id)
    SELECT f.id AS polygon, round(a.d, 6) AS nearest_ramp, round(b.d, 6) AS nearest_interstate, (SELECT count(*) FROM c WHERE c.polygon = f.id AND class = 0 AND t0 <= t1) AS ramp_count,
        round(coalesce((SELECT sum((t1 - t0) * sqrt(3.1 * 3.1 + 1.7 * 1.7)) FROM c WHERE c.polygon = f.id AND class = 2 AND t0 <= t1), 0) / (4 * r * r), 6) AS arterial_density, round(coalesce(j, 0) / (4 * r * r), 6) AS junction_density, round(dead, 6) AS dead_end_share, round(four, 6) AS four_way_share
    FROM facilities f LEFT JOIN far a ON a.polygon = f.id AND a.class = 0 LEFT JOIN far b ON b.polygon = f.id AND b.class = 1 LEFT JOIN n ON n.polygon = f.id"""


@query("l10_roadway_build", "areas", "facilities", sql=ROADWAY_SQL)
def _(areas, facilities):
    roads = areas.sparkSession.sql(ROADS.replace("FROM areas", "FROM {areas}"), areas=areas)
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("r")).alias("x"), (F.col("y") + dy * F.col("r")).alias("y"))
    squares = facilities.select(F.col("id").alias("polygon"), F.array(*[corner(*d) for d in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]).alias("ring"))
    ramps, interstates, arterials = (roads.where(F.col("class") == k) for k in (0, 1, 2))
    nodes = roads.select(F.col("x0").alias("x"), F.col("y0").alias("y"), "degree")
    found = overlay.roadway_build(squares, ramps, interstates, arterials, nodes, 5.0)
    return found.withColumns({c: r(c) for c in ("nearest_ramp", "nearest_interstate", "arterial_density", "junction_density", "dead_end_share", "four_way_share")})


@query("l8_pooled_cities", "areas", "incidents", sql="WITH n AS (SELECT area_id, count(*) AS n FROM incidents WHERE code <> '5-LOW' GROUP BY 1), p AS (SELECT city, geoid, ln(1 + least(1000.0 * coalesce(n, 0) / population, 60)) AS y FROM areas LEFT JOIN n ON area_id = id WHERE population > 0 AND city IN (SELECT city FROM areas JOIN n ON area_id = id GROUP BY city HAVING sum(n) >= 100)) SELECT city, geoid, round(y, 5) AS lograte, round((y - avg(y) OVER (PARTITION BY city)) / nullif(stddev_samp(y) OVER (PARTITION BY city), 0), 4) AS within_city FROM p")
def _(areas, incidents):
    counts = incidents.where("code <> '5-LOW'").groupBy(F.col("area_id").alias("id")).agg(F.count("*").alias("n"))
    joined = areas.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    cities = joined.groupBy("city").agg(F.sum("n").alias("all")).where("all >= 100").select("city")  # cities with enough cases are pooled
    rows = joined.where("population > 0").join(cities, "city", "left_semi").withColumn("a", 1000.0 * F.col("n") / F.col("population"))
    found = targets.targets(rows, "city", count="n", rate="a", daytime="a", cap=60.0)
    return found.select("city", "geoid", r("lograte", 5).alias("lograte"), r("lograte_within_city", 4).alias("within_city"))


_CITY = 3
_RANK = "rank() OVER (PARTITION BY city ORDER BY {c}) + (count(*) OVER (PARTITION BY city, {c}) - 1) / 2.0"
_EACH = "CASE predictor WHEN 'jobs' THEN {a} ELSE {b} END"
CITY_SQL = f"""WITH {FIT}, f AS (SELECT unnest(['jobs', 'population']) AS predictor), d AS (SELECT unnest(range(1, 4)) AS rep),
    o AS (SELECT *, row_number() OVER (ORDER BY md5(cast(id AS varchar))) AS spot FROM parts WHERE city = {_CITY}),
    e AS (SELECT predictor, rep, id, spot, y - y_pred AS e, {_EACH.format(a='c_jobs', b='c_population')} AS own FROM o, f, d), s AS (SELECT predictor, rep, own AS given, row_number() OVER (PARTITION BY predictor, rep ORDER BY md5(concat(predictor, '-', rep, '-', id))) AS spot FROM e),
    dr AS (SELECT predictor, sum(pow(e - given + own, 2) - pow(e, 2)) / 3 / (SELECT var_pop(y) * count(*) FROM o) AS fall FROM e JOIN s USING (predictor, rep, spot) GROUP BY predictor),
    k AS (SELECT city, {_RANK.format(c='x1')} AS r1, {_RANK.format(c='x2')} AS r2, {_RANK.format(c='y')} AS ry FROM r_t), c AS (SELECT city, corr(r1, ry) AS jobs, corr(r2, ry) AS population FROM k GROUP BY city),
    lo AS (SELECT predictor, max({_EACH.format(a='jobs', b='population')}) FILTER (city = {_CITY}) AS local_rho, median({_EACH.format(a='jobs', b='population')}) FILTER (city <> {_CITY}) AS others_rho FROM c, f GROUP BY predictor),
    m AS (SELECT predictor, median({_EACH.format(a='x1', b='x2')}) AS mid FROM o, f GROUP BY predictor), pc AS (SELECT predictor, (count(*) FILTER ({_EACH.format(a='x1', b='x2')} < mid) + 0.5 * count(*) FILTER ({_EACH.format(a='x1', b='x2')} = mid)) / count(*) AS pctile FROM r_t, m WHERE city <> {_CITY} GROUP BY predictor),
    sh AS (SELECT predictor, avg(abs({_EACH.format(a='c_jobs', b='c_population')})) AS v FROM o, f GROUP BY predictor)
    SELECT predictor, round(v / (SELECT sum(v) FROM sh), 6) AS share, round(fall, 6) AS "drop", round(local_rho, 5) AS local_rho, round(others_rho, 5) AS others_rho, cast(sign({_EACH.format(a='b1', b='b2')}) AS double) AS model_dir, sign(local_rho) = sign({_EACH.format(a='b1', b='b2')}) AS agrees, round(pctile, 6) AS pctile
    FROM sh JOIN dr USING (predictor) JOIN lo USING (predictor) JOIN pc USING (predictor), fit WHERE fit.city = {_CITY}"""


@query("h9_city_features", "areas", sql=CITY_SQL)
def _(areas):
    found = attribution.city_features(*fitted(areas), _CITY, "id")
    return found.select("predictor", "agrees", *[r(c, 5 if c in ("local_rho", "others_rho", "model_dir") else 6).alias(c) for c in ("share", "drop", "local_rho", "others_rho", "model_dir", "pctile")])
