"""One query for each operator of the inventory, with an independent SQL statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealens.functions import columns as C
from arealens.operators import aggregates, cleaning, curves, ranks, regression, spatial
from arealens.operators.graph import connected_components
from arealens.operators.joins import BROADCAST_BYTES, join_keyed, table_bytes
from arealens.plans.views import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CATEGORIES = {"1-URGENT": "robbery", "2-HIGH": "assault", "3-MEDIUM": "larceny", "4-NOT SPECIFIED": "vandalism"}
CASE = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " END"


def query(name: str, *tables: str, sql: str = "") -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of tables under ``name``."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return register


def r(c, digits: int = 6):
    return F.round(c, digits)


# Cleaning


@query("p1_date_window", "incidents", sql="SELECT id, code FROM incidents WHERE occurred >= TIMESTAMP '1995-01-01' AND occurred < TIMESTAMP '1996-01-01'")
def _(incidents):
    return cleaning.date_window(incidents, "occurred", "1995-01-01", "1996-01-01").select("id", "code")


@query("p2_explode_codes", "part", sql="SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS code FROM part")
def _(part):
    return cleaning.explode_codes(part, "p_name", " ", "code").select("p_partkey", "code")


@query("p3_wkt_points", "incidents", sql=r"SELECT id, try_cast(regexp_extract(wkt, 'POINT \((\S+) (\S+)\)', 1) AS double) AS px, try_cast(regexp_extract(wkt, 'POINT \((\S+) (\S+)\)', 2) AS double) AS py FROM incidents")
def _(incidents):
    px, py = cleaning.wkt_point(F.col("wkt"))
    return incidents.select("id", px.alias("px"), py.alias("py"))


@query("p5_drop_sentinels", "incidents", sql="SELECT id FROM incidents WHERE x IS NULL OR NOT ((round(x, 5) = 79.19 AND round(y, 5) = 46.38) OR (round(x, 5) = 58.31 AND round(y, 5) = 92.76))")
def _(incidents):
    return cleaning.drop_points(incidents, "x", "y", [(79.19, 46.38), (58.31, 92.76)]).select("id")


@query("p6_dedup_prefer_located", "incidents", sql="SELECT area_id, code, id, x FROM (SELECT *, row_number() OVER (PARTITION BY area_id, code ORDER BY (x IS NOT NULL) DESC, id) AS k FROM incidents) WHERE k = 1")
def _(incidents):
    return cleaning.dedup_prefer(incidents, ["area_id", "code"], F.col("x").isNotNull(), ["id"]).select("area_id", "code", "id", "x")


@query("p8_map_codes", "incidents", sql=f"SELECT id, {CASE} AS category FROM incidents")
def _(incidents):
    return cleaning.map_codes(incidents, "code", CATEGORIES, "category").select("id", "category")


@query("p9_refine", "incidents", sql=f"SELECT id, CASE WHEN code = '1-URGENT' AND NOT coalesce(regexp_matches(status, '(?i)^f'), false) THEN NULL ELSE {CASE} END AS category FROM incidents")
def _(incidents):
    mapped = cleaning.map_codes(incidents, "code", CATEGORIES, "category")
    return cleaning.refine(mapped, "code", "status", {"1-URGENT": "^f"}, "category").select("id", "category")


@query("p10_mapping_report", "incidents", sql=f"SELECT coalesce({CASE}, code) AS name, ({CASE}) IS NOT NULL AS mapped, count(*) AS n FROM incidents GROUP BY 1, 2")
def _(incidents):
    mapped = cleaning.map_codes(incidents, "code", CATEGORIES, "category")
    return mapped.groupBy(F.coalesce("category", "code").alias("name"), F.col("category").isNotNull().alias("mapped")).agg(F.count("*").alias("n"))


@query("p11_keys", "areas", sql="SELECT geoid, substr(geoid, 1, 5) AS county, substr(geoid, 1, 2) AS state2, lpad(geoid, 15, '0') AS block FROM areas")
def _(areas):
    return areas.select("geoid", F.substring("geoid", 1, 5).alias("county"), F.substring("geoid", 1, 2).alias("state2"), F.lpad("geoid", 15, "0").alias("block"))


@query("p16_population_floor", "areas", sql="SELECT geoid, population, population + jobs AS daytime FROM areas WHERE population > 0 AND population + jobs >= 1000")
def _(areas):
    return areas.where("population > 0 and population + jobs >= 1000").select("geoid", "population", (F.col("population") + F.col("jobs")).alias("daytime"))


@query("p21_eligible_cities", "areas", "incidents", sql="SELECT city, round(sum(amount), 4) AS observed FROM areas JOIN incidents USING (geoid) GROUP BY city HAVING sum(abs(amount)) > 0 AND city % 2 = 0")
def _(areas, incidents):
    sums = areas.join(incidents, "geoid").groupBy("city").agg(r(F.sum("amount"), 4).alias("observed"), F.sum(F.abs("amount")).alias("m"))
    return sums.where("m > 0 and city % 2 = 0").drop("m")


@query("p23_varying_columns", "areas", sql="SELECT round(avg(a), 4) AS balance, round(avg(b), 6) AS state FROM (SELECT city, stddev_samp(balance) AS a, stddev_samp(state) AS b FROM areas GROUP BY city)")
def _(areas):
    return areas.groupBy("city").agg(F.stddev_samp("balance").alias("a"), F.stddev_samp("state").alias("b")).agg(r(F.avg("a"), 4).alias("balance"), r(F.avg("b")).alias("state"))


# Joins


@query("j1_left_chain", "areas", "incidents", "exposures", sql="SELECT a.geoid, i.n, e.q FROM areas a LEFT JOIN (SELECT geoid, count(*) AS n FROM incidents GROUP BY 1) i USING (geoid) LEFT JOIN (SELECT agency, sum(exposure) AS q FROM exposures GROUP BY 1) e ON e.agency = a.id")
def _(areas, incidents, exposures):
    counts = incidents.groupBy("geoid").agg(F.count("*").alias("n"))
    sums = exposures.groupBy(F.col("agency").alias("id")).agg(F.sum("exposure").alias("q"))
    return areas.join(counts, "geoid", "left").join(sums, "id", "left").select("geoid", "n", "q")


@query("j3_semi_join", "areas", "incidents", sql="SELECT geoid FROM areas WHERE geoid IN (SELECT geoid FROM incidents WHERE code = '1-URGENT')")
def _(areas, incidents):
    return areas.join(incidents.where("code = '1-URGENT'"), "geoid", "left_semi").select("geoid")


def diamonds(facilities):
    at = lambda dx, dy: F.struct((F.col("x") + dx * F.col("r")).alias("x"), (F.col("y") + dy * F.col("r")).alias("y"))
    ring = F.array(at(1, 0), at(0, 1), at(-1, 0), at(0, -1), at(1, 0))
    return facilities.select(F.col("id").alias("place"), ring.alias("ring"))


@query("j5_point_in_polygon", "incidents", "facilities", sql="SELECT i.id, f.id AS place FROM incidents i JOIN facilities f ON abs(i.x - f.x) + abs(i.y - f.y) < f.r")
def _(incidents, facilities):
    return spatial.points_in_polygons(incidents.where("x is not null").select("id", "x", "y"), diamonds(facilities), "x", "y", "ring", 4.0).select("id", "place")


@query("j9_nearest_facility", "areas", "facilities", sql="SELECT a.id, round(min(sqrt(pow(a.x - f.x, 2) + pow(a.y - f.y, 2))), 6) AS dist FROM areas a, facilities f GROUP BY a.id")
def _(areas, facilities):
    return spatial.nearest(areas, facilities, 4.0).select("id", r("dist").alias("dist"))


KNN = "SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rnk FROM (SELECT a.id AS src, b.id AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM areas a JOIN areas b ON a.state = b.state AND a.id <> b.id AND abs(a.x - b.x) <= 12 AND abs(a.y - b.y) <= 12) WHERE d <= 12"


@query("j10_knn_self_join", "areas", sql=f"SELECT src, dst, round(d, 6) AS dist, rnk FROM ({KNN}) WHERE rnk <= 6")
def _(areas):
    return spatial.knn(areas, 6, 12.0, ("state",)).select("src", "dst", r("dist").alias("dist"), "rnk")


@query("j13_near_any", "areas", "facilities", sql="SELECT a.id, max(CASE WHEN pow(a.x - f.x, 2) + pow(a.y - f.y, 2) <= 9 THEN 1 ELSE 0 END) = 1 AS near FROM areas a, facilities f GROUP BY a.id")
def _(areas, facilities):
    hit = spatial.pairs_within(areas, facilities, 3.0).select(F.col("src").alias("id")).distinct().withColumn("near", F.lit(True))
    return areas.join(hit, "id", "left").select("id", F.coalesce("near", F.lit(False)).alias("near"))


@query("j14_pairs_within", "facilities", sql="SELECT a.id AS src, b.id AS dst FROM facilities a JOIN facilities b ON a.id < b.id AND a.kind = b.kind AND a.city <> b.city AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 64")
def _(facilities):
    cities = facilities.select("id", "city")
    pairs = spatial.pairs_within(facilities, facilities, 8.0, ("kind",)).where("src < dst")
    return pairs.join(cities.toDF("src", "ca"), "src").join(cities.toDF("dst", "cb"), "dst").where("ca <> cb").select("src", "dst")


@query("j15_mutual_nearest", "facilities", sql="WITH p AS (SELECT a.id AS src, b.id AS dst, b.kind AS g, row_number() OVER (PARTITION BY a.id, b.kind ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS k FROM facilities a JOIN facilities b ON a.kind <> b.kind WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400) SELECT a.src, a.dst FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src WHERE a.k = 1 AND b.k = 1 AND a.src < a.dst")
def _(facilities):
    return spatial.mutual_nearest(facilities, "kind", 20.0)


@query("j16_cascade_lookup", "areas", "nation", sql="SELECT geoid, coalesce(a.n_name, b.n_name, 'balance') AS place FROM areas LEFT JOIN nation a ON a.n_nationkey = city AND city % 3 = 0 LEFT JOIN nation b ON b.n_nationkey = city + 1 AND city % 3 = 1")
def _(areas, nation):
    first = nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("v1"))
    second = nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("v2"))
    keyed = areas.withColumn("k1", F.when(F.col("city") % 3 == 0, F.col("city"))).withColumn("k2", F.when(F.col("city") % 3 == 1, F.col("city") + 1))
    return keyed.join(first, "k1", "left").join(second, "k2", "left").select("geoid", F.coalesce("v1", "v2", F.lit("balance")).alias("place"))


PANEL = "SELECT city, year(occurred) AS yr, round(sum(amount), 4) AS total FROM areas JOIN incidents USING (geoid) GROUP BY 1, 2"


@query("j20_as_of_year", "areas", "incidents", sql=f"SELECT city, max(yr) AS yr_used, max_by(total, yr) AS total FROM ({PANEL}) WHERE yr <= 1996 GROUP BY city")
def _(areas, incidents):
    panel = areas.join(incidents, "geoid").groupBy("city", F.year("occurred").alias("yr")).agg(r(F.sum("amount"), 4).alias("total"))
    return cleaning.as_of_latest(panel, "city", "yr", 1996, ["total"])


@query("j22_majority_area", "exposures", sql="SELECT part, agency, n FROM (SELECT part, agency, count(*) AS n, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, agency) AS k FROM exposures GROUP BY 1, 2) WHERE k = 1")
def _(exposures):
    return cleaning.majority(exposures, "part", "agency")


@query("j25_full_set", "areas", "incidents", sql="SELECT geoid, coalesce(n, 0) AS n FROM areas LEFT JOIN (SELECT geoid, count(*) AS n FROM incidents GROUP BY 1) USING (geoid) WHERE city < 10 OR coalesce(n, 0) > 0")
def _(areas, incidents):
    counts = incidents.groupBy("geoid").agg(F.count("*").alias("n"))
    return areas.join(counts, "geoid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("city < 10 or n > 0").select("geoid", "n")


# Aggregates


@query("a1_area_counts", "incidents", sql="SELECT geoid, " + ", ".join(f"count(*) FILTER ({CASE} = '{v}') AS {v}_count" for v in CATEGORIES.values()) + f", count(*) AS total_count, count(*) FILTER ({CASE} IN ('robbery', 'assault')) AS violent_count FROM incidents GROUP BY geoid")
def _(incidents):
    wide = aggregates.pivot_counts(cleaning.map_codes(incidents, "code", CATEGORIES, "category"), "geoid", "category", list(CATEGORIES.values()))
    return wide.withColumn("violent_count", F.col("robbery_count") + F.col("assault_count"))


@query("a2_filtered_sums", "exposures", sql="SELECT agency, sum(exposure) AS exposure, sum(claims) AS claims FROM exposures WHERE carrier = 'R' AND exposure > 10 GROUP BY agency")
def _(exposures):
    return exposures.where("carrier = 'R' and exposure > 10").groupBy("agency").agg(F.sum("exposure").alias("exposure"), F.sum("claims").alias("claims"))


@query("a4_weighted_mean", "areas", sql="SELECT city, round(sum(balance * population) / nullif(sum(CASE WHEN balance IS NOT NULL THEN population END), 0), 4) AS balance, round(cast(sum(jobs * population) AS double) / nullif(sum(population), 0), 4) AS jobs FROM areas GROUP BY city")
def _(areas):
    means = aggregates.weighted_mean(areas, ["city"], "population", ["balance", "jobs"])
    return means.select("city", r("balance", 4).alias("balance"), r("jobs", 4).alias("jobs"))


@query("a5_distinct_shares", "exposures", sql="SELECT agency, round(100.0 * count(DISTINCT CASE WHEN carrier = 'R' THEN part END) / count(DISTINCT part), 2) AS pct FROM exposures GROUP BY agency")
def _(exposures):
    return exposures.groupBy("agency").agg(r(100.0 * F.count_distinct(F.when(F.col("carrier") == "R", F.col("part"))) / F.count_distinct("part"), 2).alias("pct"))


@query("a10_share_of_total", "incidents", sql="SELECT code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM incidents GROUP BY code")
def _(incidents):
    counts = incidents.groupBy("code").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(incidents.agg(F.count("*").alias("t")))).select("code", "n", r(F.col("n") / F.col("t")).alias("share"))


@query("a13_equitability", "events", sql="SELECT user_id, count(*) AS n_categories, CASE WHEN count(*) <= 1 THEN 0.0 ELSE round(-sum(p * ln(p)) / ln(count(*)), 6) END AS equitability FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def _(events):
    return aggregates.equitability(events, "user_id", "event_type").select("user_id", "n_categories", r("equitability").alias("equitability"))


@query("a14_node_degree", "lineitem", sql="SELECT node, count(*) AS deg_all, count(*) FILTER (cls <> 'N') AS deg_street FROM (SELECT l_partkey AS node, l_returnflag AS cls FROM lineitem UNION ALL SELECT l_suppkey + 1000000, l_returnflag FROM lineitem) GROUP BY node")
def _(lineitem):
    ends = lineitem.select(F.explode(F.array("l_partkey", F.col("l_suppkey") + 1000000)).alias("node"), F.col("l_returnflag").alias("cls"))
    return ends.groupBy("node").agg(F.count("*").alias("deg_all"), F.count_if(F.col("cls") != "N").alias("deg_street"))


@query("a16_neighbour_aggregate", "areas", sql=f"SELECT id, round(m, 4) AS neighbour_mean, round(coalesce(s, 0.0), 4) AS neighbour_sum, coalesce(n, 0) AS n_neighbours FROM areas LEFT JOIN (SELECT src, avg(balance) AS m, sum(balance) AS s, count(*) AS n FROM ({KNN}) JOIN areas ON dst = id WHERE rnk <= 6 GROUP BY src) ON src = id")
def _(areas):
    out = aggregates.neighbour_agg(spatial.knn(areas, 6, 12.0, ("state",)), areas, "id", "balance")
    return out.select("id", r("neighbour_mean", 4).alias("neighbour_mean"), r("neighbour_sum", 4).alias("neighbour_sum"), "n_neighbours")


@query("a17_pooled_lag", "areas", sql=f"SELECT src AS id, round(cast(sum(jobs) AS double) / nullif(sum(population), 0) * 100, 6) AS lag FROM ({KNN}) JOIN areas ON dst = id WHERE rnk <= 6 GROUP BY src")
def _(areas):
    return aggregates.pooled_lag(spatial.knn(areas, 6, 12.0, ("state",)), areas, "id", "jobs", "population").select("id", r("lag").alias("lag"))


@query("a18_stop_schedule", "events", sql="SELECT user_id, count(*) AS trips, min(s) AS first_s, max(s) AS last_s, round((max(s) - min(s)) / 3600.0, 4) AS span_hours, min(s) < 18000 OR max(s) >= 86400 AS overnight FROM (SELECT user_id, hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) AS integer) + CASE WHEN event_id % 7 = 0 THEN 86400 ELSE 0 END AS s FROM events) GROUP BY user_id")
def _(events):
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts") + F.when(F.col("event_id") % 7 == 0, 86400).otherwise(0)
    stops = events.withColumn("s", s).groupBy("user_id").agg(F.count("*").alias("trips"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    return stops.select("*", r((F.col("last_s") - F.col("first_s")) / 3600.0, 4).alias("span_hours"), ((F.col("first_s") < 18000) | (F.col("last_s") >= 86400)).alias("overnight"))


@query("a23_distribution", "incidents", sql="SELECT code, round(quantile_cont(amount, 0.5), 4) AS median, round(quantile_cont(amount, 0.1), 4) AS p10, round(quantile_cont(amount, 0.9), 4) AS p90, round(quantile_cont(amount, 0.99), 4) AS p99 FROM incidents GROUP BY code")
def _(incidents):
    p = ranks.quantiles(incidents, ["code"], ["amount"], [0.5, 0.1, 0.9, 0.99])
    return p.select("code", *[r(F.col("q")[i], 4).alias(n) for i, n in enumerate(("median", "p10", "p90", "p99"))])


@query("a31_apportionment", "areas", sql="SELECT geoid, round(1000.0 * population / sum(population) OVER (PARTITION BY city), 6) AS part FROM areas")
def _(areas):
    total = areas.groupBy("city").agg(F.sum("population").alias("t"))
    return areas.join(total, "city").select("geoid", r(F.try_divide(1000.0 * F.col("population"), F.col("t"))).alias("part"))


# Windows and curves


@query("w2_average_rank", "areas", sql="SELECT geoid, round((rank() OVER (PARTITION BY city ORDER BY jobs) + (count(*) OVER (PARTITION BY city, jobs) - 1) / 2.0) / count(*) OVER (PARTITION BY city), 6) AS pct FROM areas")
def _(areas):
    return ranks.mean_ranks(areas, ["city"], {"jobs": "pct"}).select("geoid", r("pct").alias("pct"))


@query("w3_z_score", "areas", sql="SELECT geoid, round((balance - avg(balance) OVER (PARTITION BY city)) / stddev_samp(balance) OVER (PARTITION BY city), 5) AS z FROM areas")
def _(areas):
    return areas.select("geoid", r(C.z_score("balance", "city"), 5).alias("z"))


@query("w4_demean", "areas", sql="SELECT geoid, round(balance - avg(balance) OVER (PARTITION BY city), 4) AS balance, round(jobs - avg(jobs) OVER (PARTITION BY city), 4) AS jobs FROM areas")
def _(areas):
    return areas.select("geoid", r(C.demeaned("balance", "city"), 4).alias("balance"), r(C.demeaned("jobs", "city"), 4).alias("jobs"))


CURVE = """SELECT carrier, key, sum(exposure) OVER w / sum(exposure) OVER (PARTITION BY carrier) AS x, sum(claims) OVER w / sum(claims) OVER (PARTITION BY carrier) AS y,
    coalesce(sum(exposure) OVER v, 0) / sum(exposure) OVER (PARTITION BY carrier) AS x0, coalesce(sum(claims) OVER v, 0) / sum(claims) OVER (PARTITION BY carrier) AS y0
    FROM (SELECT *, id * 8 + line AS key FROM exposures) WINDOW w AS (PARTITION BY carrier ORDER BY price DESC, key ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY carrier ORDER BY price DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def carrier_curve(exposures):
    return curves.lorenz(exposures.withColumn("key", F.col("id") * 8 + F.col("line")), "price", "claims", "exposure", ["carrier"], "key")


@query("w5_lorenz", "exposures", sql=f"SELECT carrier, key, round(x, 6) AS x, round(y, 6) AS y FROM ({CURVE})")
def _(exposures):
    return carrier_curve(exposures).select("carrier", "key", r("x").alias("x"), r("y").alias("y"))


@query("w6_gini", "exposures", sql=f"SELECT carrier, round(sum((x - x0) * (y + y0)) - 1, 6) AS gini FROM ({CURVE}) GROUP BY carrier")
def _(exposures):
    return curves.gini(carrier_curve(exposures), ["carrier"]).select("carrier", r("gini").alias("gini"))


@query("w7_capture", "exposures", sql=f"SELECT carrier, round(max(y0 + (y - y0) * (0.2 - x0) / (x - x0)), 6) AS capture FROM ({CURVE}) WHERE x0 < 0.2 AND x >= 0.2 GROUP BY carrier")
def _(exposures):
    return curves.capture_at(carrier_curve(exposures), ["carrier"], 0.2).select("carrier", r("capture").alias("capture"))


@query("w9_deciles", "areas", sql="SELECT geoid, cast(greatest(1, least(10, ceil(round(10 * (rank() OVER (PARTITION BY city ORDER BY jobs) + (count(*) OVER (PARTITION BY city, jobs) - 1) / 2.0) / count(*) OVER (PARTITION BY city), 9)))) AS integer) AS decile FROM areas")
def _(areas):
    tenth = F.ceil(F.round(10 * F.col("pct"), 9))
    return ranks.mean_ranks(areas, ["city"], {"jobs": "pct"}).select("geoid", F.greatest(F.lit(1), F.least(F.lit(10), tenth)).cast("int").alias("decile"))


@query("o3_latest_vintage", "incidents", sql="SELECT area_id, yr, id FROM (SELECT area_id, year(occurred) AS yr, id, row_number() OVER (PARTITION BY area_id, year(occurred) ORDER BY occurred DESC, id DESC) AS k FROM incidents) WHERE k = 1")
def _(incidents):
    return incidents.groupBy("area_id", F.year("occurred").alias("yr")).agg(F.max(F.struct("occurred", "id")).alias("t")).select("area_id", "yr", F.col("t.id").alias("id"))


@query("o5_shared_keys", "incidents", sql="SELECT geoid FROM incidents WHERE code = '1-URGENT' INTERSECT SELECT geoid FROM incidents WHERE code = '2-HIGH'")
def _(incidents):
    return incidents.where("code = '1-URGENT'").select("geoid").intersect(incidents.where("code = '2-HIGH'").select("geoid"))


# Functions


@query("f1_rates", "areas", "incidents", sql="SELECT geoid, round(1000.0 * n / nullif(population, 0), 4) AS rate, round(1000.0 * n / nullif(population + jobs, 0), 4) AS rate_daytime FROM areas JOIN (SELECT geoid, count(*) AS n FROM incidents GROUP BY 1) USING (geoid)")
def _(areas, incidents):
    joined = areas.join(incidents.groupBy("geoid").agg(F.count("*").alias("n")), "geoid")
    return joined.select("geoid", r(C.rate(F.col("n"), F.col("population")), 4).alias("rate"), r(C.rate(F.col("n"), F.col("population") + F.col("jobs")), 4).alias("rate_daytime"))


@query("f2_composite", "areas", sql="SELECT geoid, round(1.5 * (coalesce(balance / 4500.0, 0) + coalesce(cast(jobs AS double) / nullif(population, 0) / 0.2, 0)) / (CASE WHEN balance IS NULL THEN 0 ELSE 1 END + CASE WHEN population = 0 THEN 0 ELSE 1 END), 5) AS composite FROM areas")
def _(areas):
    rates = areas.withColumn("job_rate", F.try_divide(F.col("jobs").cast("double"), F.col("population")))
    return rates.select("geoid", r(C.composite({"balance": 4500.0, "job_rate": 0.2}, 1.5), 5).alias("composite"))


@query("f4_transforms", "areas", sql="SELECT geoid, round(ln(1 + greatest(balance, 0)), 6) AS log_balance, round(sqrt(jobs), 6) AS root_jobs FROM areas")
def _(areas):
    return areas.select("geoid", r(C.transform("balance", "log1p")).alias("log_balance"), r(F.sqrt(F.greatest("jobs", F.lit(0)))).alias("root_jobs"))


@query("f6_median_fill", "areas", sql="SELECT geoid, coalesce(nullif(population, 0), m) AS population FROM areas JOIN (SELECT city, median(nullif(population, 0)) AS m FROM areas GROUP BY city) USING (city)")
def _(areas):
    known = areas.withColumn("p", F.when(F.col("population") != 0, F.col("population").cast("double")))
    return join_keyed(known, ranks.medians(known, ["city"], "p", "m"), ["city"], "left").select("geoid", F.coalesce("p", "m").alias("population"))


@query("f15_haversine", "areas", "facilities", sql="SELECT a.id, f.id AS place, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(f.y / 2 - a.y / 2) / 2), 2) + cos(radians(a.y / 2)) * cos(radians(f.y / 2)) * pow(sin(radians(f.x - a.x) / 2), 2)))), 4) AS km FROM areas a JOIN facilities f USING (city)")
def _(areas, facilities):
    # Dealt out by id: by city all pairs would be made in as many tasks as there are cities.
    areas = areas.select("city", "id", "x", "y").repartition(int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    places = facilities.select("city", F.col("id").alias("place"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    pairs = areas.join(F.broadcast(places) if table_bytes(places) <= BROADCAST_BYTES else places, "city")
    far = pairs.select("id", "place", C.haversine_km(F.col("y") / 2, F.col("x"), F.col("fy") / 2, F.col("fx")).alias("km"))
    return far.select("id", "place", C.rounded("km", 4).alias("km"))


@query("g1_components", "facilities")
def _(facilities):
    return connected_components(spatial.pairs_within(facilities, facilities, 6.0).where("src < dst"))


# Statistics, models and metrics


@query("t1_within_spearman", "areas", sql="SELECT city, round(corr(a, b), 5) AS rho FROM (SELECT city, rank() OVER (PARTITION BY city ORDER BY jobs) + (count(*) OVER (PARTITION BY city, jobs) - 1) / 2.0 AS a, rank() OVER (PARTITION BY city ORDER BY balance) + (count(*) OVER (PARTITION BY city, balance) - 1) / 2.0 AS b FROM areas) GROUP BY city")
def _(areas):
    return ranks.mean_ranks(areas, ["city"], {"jobs": "a", "balance": "b"}).groupBy("city").agg(r(F.corr("a", "b"), 5).alias("rho"))


@query("t2_variance_share", "areas", sql="WITH g AS (SELECT balance, population, avg(balance) OVER (PARTITION BY city) AS gb, avg(balance) OVER () AS ab, avg(population) OVER (PARTITION BY city) AS gp, avg(population) OVER () AS ap FROM areas) SELECT 'balance' AS \"column\", round(sum(pow(gb - ab, 2)) / sum(pow(balance - ab, 2)), 6) AS eta2 FROM g UNION ALL SELECT 'population', round(sum(pow(gp - ap, 2)) / sum(pow(population - ap, 2)), 6) FROM g")
def _(areas):
    doubled = areas.withColumn("population", F.col("population").cast("double"))
    return aggregates.variance_share(doubled, "city", ["balance", "population"]).select("column", r("eta2").alias("eta2"))


FITS = "SELECT t.city, (tn * txy - tx * ty) / (tn * txx - tx * tx) AS b, (ty - (tn * txy - tx * ty) / (tn * txx - tx * tx) * tx) / tn AS a FROM (SELECT c.city, a.n - c.n AS tn, a.x - c.x AS tx, a.y - c.y AS ty, a.xx - c.xx AS txx, a.xy - c.xy AS txy FROM (SELECT city, count(*) AS n, sum(jobs) AS x, sum(balance) AS y, sum(jobs * jobs) AS xx, sum(jobs * balance) AS xy FROM areas GROUP BY city) c, (SELECT count(*) AS n, sum(jobs) AS x, sum(balance) AS y, sum(jobs * jobs) AS xx, sum(jobs * balance) AS xy FROM areas) a) t"


@query("m1_leave_one_city_out", "areas", sql=f"SELECT geoid, round(a + b * jobs, 3) AS y_pred FROM areas JOIN ({FITS}) USING (city)")
def _(areas):
    return regression.loco_ridge(areas, ["jobs"], "balance", "city").select("geoid", r("y_pred", 3).alias("y_pred"))


RUN = "SELECT city, geoid, balance AS y, 0.9 * balance + jobs AS p FROM areas"


def scored(areas):
    return areas.select("city", "geoid", F.col("balance").alias("y"), (0.9 * F.col("balance") + F.col("jobs")).alias("p"))


@query("e1_errors", "areas", sql=f"SELECT city, round(1 - sum(pow(y - p, 2)) / (sum(y * y) - pow(sum(y), 2) / count(*)), 5) AS r2, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM ({RUN}) GROUP BY city")
def _(areas):
    square = F.pow(F.col("y") - F.col("p"), 2)
    spread = F.sum(F.col("y") * F.col("y")) - F.pow(F.sum("y"), F.lit(2)) / F.count("*")
    return scored(areas).groupBy("city").agg(r(1 - F.try_divide(F.sum(square), spread), 5).alias("r2"), r(F.sqrt(F.avg(square)), 4).alias("rmse"), r(F.avg(F.abs(F.col("y") - F.col("p"))), 4).alias("mae"))


@query("e2_recall", "areas", sql=f"SELECT city, count(*) FILTER (ty AND tp) AS hit, count(*) FILTER (ty) AS worst FROM (SELECT city, round((rank() OVER (PARTITION BY city ORDER BY y) + (count(*) OVER (PARTITION BY city, y) - 1) / 2.0) / count(*) OVER (PARTITION BY city), 9) >= 0.9 AS ty, round((rank() OVER (PARTITION BY city ORDER BY p) + (count(*) OVER (PARTITION BY city, p) - 1) / 2.0) / count(*) OVER (PARTITION BY city), 9) >= 0.9 AS tp FROM ({RUN})) GROUP BY GROUPING SETS ((city), ())")
def _(areas):
    top = lambda c: F.round(c, 9) >= 0.9
    flagged = ranks.mean_ranks(scored(areas), ["city"], {"y": "ry", "p": "rp"}).select("city", top("ry").alias("ty"), top("rp").alias("tp"))
    return flagged.groupingSets([["city"], []], "city").agg(F.count_if(F.col("ty") & F.col("tp")).alias("hit"), F.count_if("ty").alias("worst"))


@query("l1_city_stats", "areas", sql=f"SELECT city, round(sum(y * w) / nullif(sum(w), 0), 4) AS observed, round(sum(p * w) / nullif(sum(w), 0), 4) AS predicted FROM (SELECT r.*, population AS w FROM ({RUN}) r JOIN areas USING (geoid)) GROUP BY city")
def _(areas):
    run = scored(areas).join(areas.select("geoid", "population"), "geoid")
    means = aggregates.weighted_mean(run, ["city"], "population", ["y", "p"])
    return means.select("city", r("y", 4).alias("observed"), r("p", 4).alias("predicted"))


