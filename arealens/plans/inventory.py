"""Further queries of the inventory: sources, predicates, lookups, roll-ups, functions and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arealens.functions import columns as C
from arealens.operators import cleaning, ranks, reports, targets
from arealens.plans.queries import ORACLES, QUERIES, query, r
from arealens.scratch import new_path
from arealens.sources import tables

__all__ = ["ORACLES", "QUERIES"]

_ZED = "({v} - avg({v}) OVER (PARTITION BY city)) / nullif(stddev_samp({v}) OVER (PARTITION BY city), 0)"
TARGET_SQL = f"SELECT geoid, round(a, 5) AS rate, round(b, 5) AS rate_daytime, round(ln(1 + n), 5) AS logcount, round(l, 5) AS lograte, round({_ZED.format(v='a')}, 5) AS rate_within_city, round({_ZED.format(v='b')}, 5) AS rate_daytime_within_city, round({_ZED.format(v='l')}, 5) AS lograte_within_city FROM (SELECT geoid, city, n, a, b, ln(1 + a) AS l FROM (SELECT geoid, city, jobs / 3 AS n, CASE WHEN population > 0 THEN least(1000.0 * jobs / population, 700) END AS a, CASE WHEN population + jobs > 0 THEN least(1000.0 * jobs / (population + jobs), 700) END AS b FROM areas))"

# Sources


@query("s1_read_csv", "customer", sql="SELECT cast(c_custkey AS varchar) AS cust_num, c_name AS full_name FROM customer")
def _(customer):
    path = new_path(customer.sparkSession, "raw_csv")
    customer.select(F.col("c_custkey").alias("Cust #"), F.col("c_name").alias("Full Name")).write.csv(path, header=True)
    return tables.read_raw_csv(customer.sparkSession, path)


@query("s2_clean_names", "supplier", sql="SELECT s_suppkey AS supplier_num, s_name AS legal_name FROM supplier")
def _(supplier):
    raw = supplier.select(F.col("s_suppkey").alias("Suplier #"), F.col("s_name").alias(" Legal-Name "))
    return tables.clean_names(raw, {"suplier_num": "supplier_num"})


@query("s3_pruned_scan", "lineitem", sql="SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R'")
def _(lineitem):
    return lineitem.where("l_shipdate >= timestamp '1997-01-01' and l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("s4_materialize", "incidents", sql="SELECT geoid, count(*) AS n FROM incidents GROUP BY geoid")
def _(incidents):
    spark, path = incidents.sparkSession, new_path(incidents.sparkSession, "counts")
    tables.materialize(spark, path, lambda: incidents.groupBy("geoid").agg(F.count("*").alias("n")))
    return tables.materialize(spark, path, lambda: incidents.select("geoid", F.lit(0).cast("long").alias("n")))  # is not computed


@query("s5_registry", "areas", "facilities", sql="SELECT 'areas' AS layer, id AS geo, x, y FROM areas UNION ALL SELECT 'facilities', id, x, y FROM facilities")
def _(areas, facilities):
    registry = {"areas": (areas, "id"), "facilities": (facilities, "id")}
    first, second = (df.select(F.lit(name).alias("layer"), F.col(key).alias("geo"), "x", "y") for name, (df, key) in registry.items())
    return first.unionByName(second)


@query("s8_part_files", "orders", sql="SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(orders):
    spark, path = orders.sparkSession, new_path(orders.sparkSession, "parts")
    orders.select("o_orderstatus", "o_custkey", "o_totalprice").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("total"))


@query("s12_run_log", "areas", sql="SELECT geoid, population, round(jobs * 2.0, 3) AS y_pred FROM areas")
def _(areas):
    spark, path = areas.sparkSession, new_path(areas.sparkSession, "runs")
    for order, times in enumerate((1.0, 2.0)):
        tables.append_run(areas.select("geoid", (F.col("jobs") * times).alias("y_pred")), path, f"run{order}", "base", order)
    return tables.load_run(spark, path, "base", areas.select("geoid", "population"), "geoid").select("geoid", "population", r("y_pred", 3).alias("y_pred"))


@query("s13_side_table", "areas", sql="SELECT geoid, segment FROM areas")
def _(areas):
    spark, path = areas.sparkSession, new_path(areas.sparkSession, "protected")
    areas.select("geoid", "segment").write.parquet(path)
    return spark.read.parquet(path)


@query("s14_quality_gate", "incidents", sql="SELECT status, count(*) AS n, count(*) FILTER (code <> '5-LOW') AS mapped, count(DISTINCT CASE WHEN code <> '5-LOW' THEN code END) AS kinds, count(*) FILTER (code <> '5-LOW') < 0.9 * count(*) AS too_few, count(*) < 1.5 * count(*) FILTER (year(occurred) < 1996) AS shrunk, CASE WHEN count(*) FILTER (code = '2-HIGH' AND year(occurred) = 1995) = 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (code = '9-NEVER') = 0 THEN 1 ELSE 0 END AS missing FROM incidents GROUP BY status")
def _(incidents):
    mapped = incidents.withColumn("category", F.when((F.col("code") == "2-HIGH") & (F.year("occurred") == 1995), "high_95").when(F.col("code") != "5-LOW", F.col("code")))
    earlier = incidents.where("year(occurred) < 1996").groupBy("status").agg(F.count("*").alias("baseline"))
    return tables.quality_gate(mapped, "status", "category", "code", ["high_95", "9-NEVER"], earlier, least_mapped=0.9, least_growth=1.5)


@query("s15_coverage", "incidents", sql="SELECT unnest(['x', 'wkt']) AS \"column\", round(unnest([100.0 * count(x) / count(*), 100.0 * count(wkt) / count(*)]), 6) AS pct FROM incidents")
def _(incidents):
    return tables.coverage(incidents, ["x", "wkt"]).select("column", r("pct").alias("pct"))


@query("s16_drift", "areas", sql="SELECT 'balance' AS \"column\", count(*) FILTER (city = 3 OR id % 19 = 0) AS unmatched, round(max(CASE WHEN id % 4 = 0 AND city <> 3 AND id % 19 <> 0 THEN 0.25 + jobs / 1e4 ELSE 0 END), 6) AS largest FROM areas")
def _(areas):
    # A table written earlier that lacks a city, has values that differ, and some that are missing.
    change = F.when(F.col("id") % 4 == 0, 0.25 + F.col("jobs") / 1e4).otherwise(0.0)
    cached = areas.where("city <> 3").withColumn("balance", F.when(F.col("id") % 19 != 0, F.col("balance") - change))
    return tables.drift(cached, areas, "geoid", ["balance"]).withColumn("largest", r("largest"))


# Predicates and cleaning


@query("p4_lenient_numbers", "incidents", sql="SELECT id, try_cast(replace(wkt, 'POINT (', '') AS double) AS v, try_cast(substr(geoid, 9, 4) AS double) AS tail FROM incidents")
def _(incidents):
    return incidents.select("id", F.replace("wkt", F.lit("POINT ("), F.lit("")).try_cast("double").alias("v"), F.substring("geoid", 9, 4).try_cast("double").alias("tail"))


@query("p7_usable_points", "incidents", sql="SELECT code, count(*) AS n, count(x) AS located, round(count(x) / count(*), 6) AS share FROM incidents GROUP BY code")
def _(incidents):
    return incidents.groupBy("code").agg(F.count("*").alias("n"), F.count("x").alias("located"), r(F.count("x") / F.count("*")).alias("share"))


@query("p12_key_consistency", "incidents", sql="SELECT round(avg(CASE WHEN cast(geoid AS bigint) = area_id THEN 1.0 ELSE 0.0 END), 6) AS share FROM incidents")
def _(incidents):
    return incidents.agg(r(F.avg((F.col("geoid").cast("long") == F.col("area_id")).cast("double"))).alias("share"))


@query("p13_store_predicates", "part", sql="SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_type LIKE '%E%' AND NOT p_brand LIKE '%4' AND NOT regexp_matches(coalesce(p_name, ''), '^g')")
def _(part):
    named = F.col("p_type").like("%E%") & ~F.col("p_brand").like("%4") & ~F.coalesce("p_name", F.lit("")).rlike("^g")
    return part.where(F.col("p_size").isin(1, 5, 9) & named).select("p_partkey")


@query("p14_predicate_builder", "part", sql="SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND (lower(p_name) LIKE '%a%' OR lower(p_brand) LIKE '%a%' OR lower(p_name) LIKE '%brand#1%' OR lower(p_brand) LIKE '%brand#1%')")
def _(part):
    return part.where(cleaning.match_predicate("p_size", [1, 2, 3], ["p_name", "p_brand"], ["%A%", "%Brand#1%"])).select("p_partkey")


@query("p15_sane_points", "incidents", sql="SELECT id FROM incidents WHERE x BETWEEN 10 AND 90 AND y BETWEEN 5 AND 95 AND NOT (x = 0 AND y = 0)")
def _(incidents):
    return incidents.where("x between 10 and 90 and y between 5 and 95 and not (x = 0 and y = 0)").select("id")


@query("p17_scope", "areas", sql="SELECT geoid, city < 10 AS inside FROM areas WHERE city < 10")
def _(areas):
    return areas.withColumn("inside", F.col("city") < 10).where("inside").select("geoid", "inside")


@query("p18_complete_cases", "incidents", sql="SELECT id FROM incidents WHERE x IS NOT NULL AND y IS NOT NULL AND wkt <> 'REDACTED'")
def _(incidents):
    return incidents.withColumn("wkt", F.nullif("wkt", F.lit("REDACTED"))).dropna(subset=["x", "y", "wkt"]).select("id")


@query("p19_shared_keys", "incidents", sql="SELECT id FROM incidents WHERE geoid IN (SELECT geoid FROM incidents WHERE status = 'F' INTERSECT SELECT geoid FROM incidents WHERE status = 'O')")
def _(incidents):
    keys = incidents.where("status = 'F'").select("geoid").intersect(incidents.where("status = 'O'").select("geoid"))
    return incidents.join(keys, "geoid", "left_semi").select("id")


@query("p20_trim_keys", "part", sql="SELECT trim(concat('  ', p_brand, ' ')) AS brand, count(*) AS n FROM part GROUP BY 1")
def _(part):
    padded = part.withColumn("brand", F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    return padded.withColumn("brand", F.trim("brand")).groupBy("brand").agg(F.count("*").alias("n"))


@query("p24_agency_keys", "supplier", sql=r"SELECT s_suppkey, concat(regexp_replace(s_name, '\W', '', 'g'), '_', s_nationkey) AS akey FROM supplier")
def _(supplier):
    return supplier.select("s_suppkey", F.concat(F.regexp_replace("s_name", r"\W", ""), F.lit("_"), F.col("s_nationkey").cast("string")).alias("akey"))


@query("p25_record_filters", "lineitem", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND year(l_shipdate) BETWEEN 1994 AND 1996 AND l_extendedprice >= 500 AND l_linestatus <> 'O'")
def _(lineitem):
    return lineitem.where("l_returnflag in ('A', 'R') and year(l_shipdate) between 1994 and 1996 and l_extendedprice >= 500 and l_linestatus <> 'O'").select("l_orderkey", "l_linenumber")


# Joins


@query("j2_match_report", "areas", "incidents", sql="SELECT a.city, count(*) AS n, round(avg(CASE WHEN i.geoid IS NULL THEN 0.0 ELSE 1.0 END), 6) AS matched FROM areas a LEFT JOIN (SELECT DISTINCT geoid FROM incidents WHERE status = 'P') i USING (geoid) GROUP BY a.city")
def _(areas, incidents):
    hit = incidents.where("status = 'P'").select("geoid").distinct().withColumn("hit", F.lit(1.0))
    return areas.join(hit, "geoid", "left").groupBy("city").agg(F.count("*").alias("n"), r(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("matched"))


@query("j4_outer_join", "incidents", sql="SELECT coalesce(a.geoid, b.geoid) AS geoid, a.n AS urgent, b.n AS high FROM (SELECT geoid, count(*) AS n FROM incidents WHERE code = '1-URGENT' GROUP BY 1) a FULL JOIN (SELECT geoid, count(*) AS n FROM incidents WHERE code = '2-HIGH' GROUP BY 1) b ON a.geoid = b.geoid")
def _(incidents):
    counts = lambda code, name: incidents.where(F.col("code") == code).groupBy("geoid").agg(F.count("*").alias(name))
    return counts("1-URGENT", "urgent").join(counts("2-HIGH", "high"), "geoid", "full_outer")


@query("j17_first_match", "exposures", sql="SELECT agency, part FROM (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY id, line) AS k FROM exposures) WHERE k = 1")
def _(exposures):
    return exposures.groupBy("agency").agg(F.min(F.struct("id", "line", "part")).alias("m")).select("agency", "m.part")


@query("j18_key_remap", "areas", "nation", sql="SELECT geoid, n_name FROM areas JOIN nation ON n_nationkey = CASE WHEN city >= 20 THEN city - 20 ELSE city END")
def _(areas, nation):
    keyed = areas.withColumn("n_nationkey", F.when(F.col("city") >= 20, F.col("city") - 20).otherwise(F.col("city")))
    return keyed.join(nation, "n_nationkey").select("geoid", "n_name")


@query("j19_national_row", "areas", sql="SELECT geoid, round(balance / (SELECT avg(balance) FROM areas), 6) AS relative FROM areas")
def _(areas):
    national = areas.agg(F.avg("balance").alias("m"))  # one row
    return areas.crossJoin(F.broadcast(national)).select("geoid", r(F.try_divide("balance", "m")).alias("relative"))


@query("j21_override", "areas", "nation", sql="SELECT geoid, CASE WHEN city = 4 THEN 'FIXED' ELSE n_name END AS akey FROM areas LEFT JOIN nation ON n_nationkey = city")
def _(areas, nation):
    override = nation.where("n_nationkey = 4").select(F.col("n_nationkey").alias("city"), F.lit("FIXED").alias("own"))
    named = areas.join(override, "city", "left").join(nation.select(F.col("n_nationkey").alias("city"), "n_name"), "city", "left")
    return named.select("geoid", F.coalesce("own", "n_name").alias("akey"))


@query("j23_dedup_dimension", "incidents", sql="SELECT area_id, id, x FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY (x IS NOT NULL) DESC, id) AS k FROM incidents) WHERE k = 1")
def _(incidents):
    return cleaning.dedup_prefer(incidents, ["area_id"], F.col("x").isNotNull(), ["id"]).select("area_id", "id", "x")


@query("j26_fill_levels", "areas", sql="""WITH a AS (SELECT geoid, city, state, population, CASE WHEN id % 3 = 0 OR city % 4 = 1 THEN NULL ELSE balance END AS v FROM areas),
    c AS (SELECT city, sum(v * population) / nullif(sum(CASE WHEN v IS NOT NULL THEN population END), 0) AS m FROM a GROUP BY city), s AS (SELECT state, sum(v * population) / nullif(sum(CASE WHEN v IS NOT NULL THEN population END), 0) AS m FROM a GROUP BY state)
    SELECT geoid, round(coalesce(v, c.m, s.m), 4) AS v FROM a LEFT JOIN c USING (city) LEFT JOIN s USING (state)""")
def _(areas):
    gaps = areas.withColumn("v", F.when((F.col("id") % 3 != 0) & (F.col("city") % 4 != 1), F.col("balance")))
    return reports.fill_from_levels(gaps, "v", "population", ["city", "state"]).select("geoid", r("v", 4).alias("v"))


@query("j27_covered_override", "areas", sql="SELECT geoid, round(CASE WHEN jobs > 0.75 * population AND balance > 0 THEN balance ELSE population END, 4) AS v FROM areas")
def _(areas):
    return areas.select("geoid", r(F.when((F.col("jobs") > 0.75 * F.col("population")) & (F.col("balance") > 0), F.col("balance")).otherwise(F.col("population").cast("double")), 4).alias("v"))


@query("j28_predominant", "exposures", sql="SELECT agency, part FROM (SELECT agency, part, row_number() OVER (PARTITION BY agency ORDER BY sum(exposure) DESC, part DESC) AS k FROM exposures GROUP BY agency, part) WHERE k = 1")
def _(exposures):
    sums = exposures.groupBy("agency", "part").agg(F.sum("exposure").alias("q"))
    return sums.groupBy("agency").agg(F.max_by("part", F.struct("q", "part")).alias("part"))


@query("j29_cast_key", "incidents", "customer", sql="SELECT id, c_name FROM incidents JOIN customer ON cast(c_custkey AS varchar) = cast(area_id AS varchar)")
def _(incidents, customer):
    return incidents.withColumn("k", F.col("area_id").cast("string")).join(customer.withColumn("k", F.col("c_custkey").cast("string")), "k").select("id", "c_name")


# Aggregates


@query("a3_block_sums", "areas", sql="SELECT substr(geoid, 1, 11) AS tract, sum(jobs) AS jobs FROM areas GROUP BY 1")
def _(areas):
    return areas.groupBy(F.substring("geoid", 1, 11).alias("tract")).agg(F.sum("jobs").alias("jobs"))


@query("a6_flagged_distinct", "exposures", sql="SELECT agency, count(DISTINCT CASE WHEN exposure > 25 THEN part END) AS large, bool_or(price > 50000) AS any_high FROM exposures GROUP BY agency")
def _(exposures):
    return exposures.groupBy("agency").agg(F.count_distinct(F.when(F.col("exposure") > 25, F.col("part"))).alias("large"), F.bool_or(F.col("price") > 50000).alias("any_high"))


@query("a7_count_ratio", "exposures", sql="SELECT agency, round(count(*) FILTER (carrier = 'R') / count(*), 4) AS share, round(avg(exposure), 2) AS mean FROM exposures GROUP BY agency")
def _(exposures):
    return exposures.groupBy("agency").agg(r(F.count_if(F.col("carrier") == "R") / F.count("*"), 4).alias("share"), r(F.avg("exposure"), 2).alias("mean"))


@query("a8_two_level_ratio", "exposures", sql="SELECT agency, round(sum(v) / sum(n), 6) AS vacancy FROM (SELECT agency, part, count(*) AS n, count(*) FILTER (carrier = 'N') AS v FROM exposures GROUP BY 1, 2) GROUP BY agency")
def _(exposures):
    parcels = exposures.groupBy("agency", "part").agg(F.count("*").alias("n"), F.count_if(F.col("carrier") == "N").alias("v"))
    return parcels.groupBy("agency").agg(r(F.sum("v") / F.sum("n")).alias("vacancy"))


@query("a9_mean_point", "incidents", sql="SELECT geoid, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM incidents GROUP BY geoid")
def _(incidents):
    return incidents.groupBy("geoid").agg(r(F.avg(F.col("x").try_cast("double"))).alias("x"), r(F.avg("y")).alias("y"))


@query("a11_named_counts", "part", sql="SELECT p_brand, upper(p_type) AS kind, count(*) AS n FROM part GROUP BY 1, 2")
def _(part):
    return part.groupBy("p_brand", F.upper("p_type").alias("kind")).agg(F.count("*").alias("n"))


@query("a12_stop_aggregate", "events", sql="SELECT user_id, count(*) AS stops, round(sum(value), 4) AS trips, round(avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS flagged FROM events GROUP BY user_id")
def _(events):
    return events.groupBy("user_id").agg(F.count("*").alias("stops"), r(F.sum("value"), 4).alias("trips"), r(F.avg((F.col("event_id") % 7 == 0).cast("double"))).alias("flagged"))


@query("a15_node_kinds", "lineitem", sql="SELECT node % 50 AS area, round(count(*) FILTER (d = 3) / nullif(count(*) FILTER (d >= 3), 0), 6) AS t_ratio, count(*) FILTER (d = 1) AS dead_ends FROM (SELECT l_partkey AS node, count(*) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) GROUP BY 1")
def _(lineitem):
    degrees = lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("d"))
    d = F.col("d")
    return degrees.groupBy((F.col("node") % 50).alias("area")).agg(r(F.try_divide(F.count_if(d == 3), F.count_if(d >= 3))).alias("t_ratio"), F.count_if(d == 1).alias("dead_ends"))


@query("a20_cluster_merge", "facilities", sql="SELECT city, max_by(id, cast(r AS double) * 1e9 - id) AS busiest, round(sum(cast(r AS double)), 4) AS service, bool_or(kind = 2) AS any_late, round(max(x) - min(x), 6) AS span FROM facilities GROUP BY city")
def _(facilities):
    return facilities.groupBy("city").agg(F.max_by("id", F.struct("r", -F.col("id"))).alias("busiest"), r(F.sum(F.col("r").cast("double")), 4).alias("service"), F.bool_or(F.col("kind") == 2).alias("any_late"), r(F.max("x") - F.min("x")).alias("span"))


@query("a21_route_types", "events", sql="SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def _(events):
    return events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("a24_describe", "areas", sql="SELECT 'balance' AS \"column\", count(balance) AS n, count(*) - count(balance) AS missing, round(avg(balance), 4) AS mean, round(stddev_samp(balance), 4) AS sd, round(quantile_cont(balance, 0.25), 4) AS p25, round(median(balance), 4) AS p50, round(quantile_cont(balance, 0.75), 4) AS p75, round(skewness(balance), 6) AS skew FROM areas")
def _(areas):
    d = reports.describe(areas, ["balance"])
    return d.select("column", "n", "missing", *[r(c, 4).alias(c) for c in ("mean", "sd", "p25", "p50", "p75")], r("skew").alias("skew"))


@query("a25_histogram", "areas", sql="SELECT cast(CASE WHEN jobs < 100 THEN 0 WHEN jobs >= 800 THEN 8 ELSE floor((jobs - 100) / 100.0) + 1 END AS bigint) AS bin, count(*) AS n FROM areas GROUP BY 1")
def _(areas):
    return reports.histogram(areas, "jobs", 100.0, 800.0, 7)


@query("a27_city_medians", "areas", sql="WITH m AS (SELECT city, median(jobs) AS med FROM areas GROUP BY city) SELECT city, med, round(coalesce((med - (SELECT avg(med) FROM m)) / nullif((SELECT stddev_samp(med) FROM m), 0), 0), 6) AS z FROM m")
def _(areas):
    med = ranks.medians(areas, ["city"], "jobs", "med")
    spread = med.agg(F.avg("med").alias("m"), F.nullif(F.stddev_samp("med"), F.lit(0.0)).alias("s"))  # one row
    return med.crossJoin(F.broadcast(spread)).select("city", "med", r(F.coalesce((F.col("med") - F.col("m")) / F.col("s"), F.lit(0.0))).alias("z"))


@query("a28_zero_and_missing", "incidents", sql="SELECT code, round(avg(CASE WHEN x IS NULL THEN 100.0 ELSE 0.0 END), 6) AS missing_pct, round(avg(CASE WHEN status = 'P' THEN 100.0 ELSE 0.0 END), 6) AS p_pct FROM incidents GROUP BY code")
def _(incidents):
    pct = lambda c: r(F.avg(F.when(c, 100.0).otherwise(0.0)))
    return incidents.groupBy("code").agg(pct(F.col("x").isNull()).alias("missing_pct"), pct(F.col("status") == "P").alias("p_pct"))


@query("a30_largest_strata", "exposures", sql="SELECT carrier, agency, sum(claims) AS claims FROM exposures GROUP BY 1, 2 ORDER BY claims DESC, carrier, agency LIMIT 20")
def _(exposures):
    return exposures.groupBy("carrier", "agency").agg(F.sum("claims").alias("claims")).orderBy(F.desc("claims"), "carrier", "agency").limit(20)


@query("a33_group_max", "areas", sql="SELECT geoid, max(jobs) OVER (PARTITION BY city) AS city_max FROM areas")
def _(areas):
    return areas.join(areas.groupBy("city").agg(F.max("jobs").alias("city_max")), "city").select("geoid", "city_max")


@query("a34_mixed_rollup", "incidents", sql="SELECT area_id, count(*) AS n, round(avg(amount), 6) AS mean, round(sum(CASE WHEN code = '1-URGENT' THEN amount END), 2) AS urgent FROM incidents GROUP BY area_id")
def _(incidents):
    return incidents.groupBy("area_id").agg(F.count("*").alias("n"), r(F.avg("amount")).alias("mean"), r(F.sum(F.when(F.col("code") == "1-URGENT", F.col("amount"))), 2).alias("urgent"))


@query("a35_completeness", "incidents", sql="SELECT code, round(least(count(x), count(amount)) / count(*), 6) AS complete, round(sum(CASE WHEN x IS NOT NULL AND amount IS NOT NULL THEN amount END) / sum(amount), 6) AS weighted FROM incidents GROUP BY code")
def _(incidents):
    whole = F.col("x").isNotNull() & F.col("amount").isNotNull()
    weighted = F.try_divide(F.sum(F.when(whole, F.col("amount"))), F.sum("amount"))
    return incidents.groupBy("code").agg(r(F.least(F.count("x"), F.count("amount")) / F.count("*")).alias("complete"), r(weighted).alias("weighted"))


# Windows


@query("w10_share_in_group", "areas", sql="SELECT geoid, round(jobs / nullif(sum(jobs) OVER (PARTITION BY city), 0), 8) AS share FROM areas")
def _(areas):
    return areas.join(areas.groupBy("city").agg(F.sum("jobs").alias("t")), "city").select("geoid", r(F.try_divide(F.col("jobs"), F.col("t")), 8).alias("share"))


@query("w11_forward_fill", "incidents", sql="SELECT id, last_value(x IGNORE NULLS) OVER (PARTITION BY area_id ORDER BY occurred, id ROWS UNBOUNDED PRECEDING) AS x FROM incidents")
def _(incidents):
    before = Window.partitionBy("area_id").orderBy("occurred", "id").rowsBetween(Window.unboundedPreceding, 0)
    return incidents.select("id", F.last("x", ignorenulls=True).over(before).alias("x"))


@query("w12_mid_rank", "areas", sql="SELECT city, round(avg(CASE WHEN jobs < 450 THEN 1.0 WHEN jobs = 450 THEN 0.5 ELSE 0.0 END), 6) AS p FROM areas GROUP BY city")
def _(areas):
    return areas.groupBy("city").agg(r(F.avg(F.when(F.col("jobs") < 450, 1.0).when(F.col("jobs") == 450, 0.5).otherwise(0.0))).alias("p"))


@query("o1_top_rows", "areas", sql="SELECT geoid, jobs FROM areas ORDER BY jobs DESC, geoid LIMIT 25")
def _(areas):
    return areas.orderBy(F.desc("jobs"), "geoid").limit(25).select("geoid", "jobs")


@query("o2_stack", "areas", "facilities", sql="SELECT id, city, state, NULL AS kind FROM areas UNION ALL SELECT id, city, NULL, kind FROM facilities")
def _(areas, facilities):
    return areas.select("id", "city", "state").unionByName(facilities.select("id", "city", "kind"), allowMissingColumns=True)


# Functions


@query("f5_hurdle", "areas", sql="SELECT geoid, CASE WHEN jobs > 300 THEN 1.0 ELSE 0.0 END AS served, round(CASE WHEN jobs > 300 THEN ln(1 + jobs) - (SELECT avg(ln(1 + jobs)) FROM areas WHERE jobs > 300) ELSE 0 END, 6) AS mass FROM areas")
def _(areas):
    served = F.col("jobs") > 300
    centre = areas.where(served).agg(F.avg(F.log1p("jobs")).alias("m"))  # one row
    return areas.crossJoin(F.broadcast(centre)).select("geoid", served.cast("double").alias("served"), r(F.when(served, F.log1p("jobs") - F.col("m")).otherwise(0.0)).alias("mass"))


@query("f8_target_modes", "areas", sql=TARGET_SQL)
def _(areas):
    rates = areas.select("geoid", "city", (F.col("jobs") / F.lit(3)).alias("n"), C.rate(F.col("jobs"), F.col("population")).alias("a"), C.rate(F.col("jobs"), F.col("population") + F.col("jobs")).alias("b"))
    found = targets.targets(rates, "city", count="n", rate="a", daytime="b", cap=700.0)
    return found.select("geoid", *[r(m, 5).alias(m) for m in targets.MODES])


@query("f9_dummies", "areas", sql="SELECT geoid, CASE WHEN state = 1 THEN 1.0 ELSE 0.0 END AS div_1, CASE WHEN state = 2 THEN 1.0 ELSE 0.0 END AS div_2 FROM areas")
def _(areas):
    return areas.select("geoid", *[(F.col("state") == k).cast("double").alias(f"div_{k}") for k in (1, 2)])


@query("f11_density", "areas", sql="SELECT geoid, round(jobs / greatest(population / 1e3, 0.5), 6) AS density FROM areas")
def _(areas):
    return areas.select("geoid", r(F.col("jobs") / F.greatest(F.col("population") / F.lit(1e3), F.lit(0.5))).alias("density"))


@query("f13_logs", "areas", sql="SELECT geoid, round(log10(101 + jobs), 6) AS l, round(sqrt(1 + jobs), 6) AS s, round((jobs - (SELECT avg(jobs) FROM areas)) / (SELECT stddev_samp(jobs) FROM areas), 6) AS z FROM areas")
def _(areas):
    moments = areas.agg(F.avg("jobs").alias("m"), F.stddev_samp("jobs").alias("d"))  # one row
    return areas.crossJoin(F.broadcast(moments)).select("geoid", r(F.log10(F.col("jobs") + 101)).alias("l"), r(F.sqrt(F.col("jobs") + 1)).alias("s"), r(F.try_divide(F.col("jobs") - F.col("m"), F.col("d"))).alias("z"))


@query("f19_daytime_rate", "areas", sql="SELECT geoid, round(CASE WHEN population + jobs > 0 THEN balance * population / (population + jobs) ELSE balance END, 7) AS v FROM areas")
def _(areas):
    base = F.col("population") + F.col("jobs")
    return areas.select("geoid", r(F.when(base > 0, F.try_divide(F.col("balance") * F.col("population"), base)).otherwise(F.col("balance")), 7).alias("v"))


@query("f23_extrapolate", "areas", "incidents", sql="WITH p AS (SELECT city, year(occurred) AS yr, sum(amount) AS t FROM areas JOIN incidents USING (geoid) GROUP BY 1, 2) SELECT c.city, round(coalesce(2 * c.t - o.t, c.t), 2) AS next FROM p c LEFT JOIN p o ON o.city = c.city AND o.yr = 1994 WHERE c.yr = 1996")
def _(areas, incidents):
    panel = areas.join(incidents, "geoid").groupBy("city", F.year("occurred").alias("yr")).agg(F.sum("amount").alias("t"))
    old = panel.where("yr = 1994").select("city", F.col("t").alias("o"))
    return panel.where("yr = 1996").join(old, "city", "left").select("city", r(F.coalesce(2 * F.col("t") - F.col("o"), "t"), 2).alias("next"))


@query("f28_part_ratio", "areas", sql="SELECT geoid, round(coalesce(least(2.0, greatest(0.5, population / nullif(avg(population) OVER (PARTITION BY city), 0))), 1), 6) AS ratio FROM areas")
def _(areas):
    parent = areas.groupBy("city").agg(F.avg("population").alias("m"))
    ratio = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.try_divide("population", "m")))
    return areas.join(parent, "city").select("geoid", r(F.coalesce(F.when(F.col("m") != 0, ratio), F.lit(1.0))).alias("ratio"))


@query("f33_dates", "incidents", sql="SELECT id, year(occurred) AS yr, isodow(occurred) < 6 AS weekday, datediff('day', DATE '1995-06-15', cast(occurred AS date)) AS days FROM incidents")
def _(incidents):
    return incidents.select("id", F.year("occurred").alias("yr"), (F.weekday("occurred") < 5).alias("weekday"), F.datediff(F.col("occurred").cast("date"), F.lit("1995-06-15").cast("date")).alias("days"))


# Statistics


@query("t4_correlations", "areas", sql="SELECT unnest(['balance', 'balance', 'jobs']) AS a, unnest(['jobs', 'population', 'population']) AS b, round(unnest([corr(balance, jobs), corr(balance, population), corr(jobs, population)]), 6) AS r FROM areas")
def _(areas):
    return reports.correlations(areas, ["balance", "jobs", "population"]).select("a", "b", r("r").alias("r"))


@query("t8_variance_split", "areas", sql="WITH g AS (SELECT city, balance, avg(balance) OVER (PARTITION BY city) AS m, avg(balance) OVER () AS t FROM areas) SELECT count(*) AS n, count(DISTINCT city) AS n_groups, round(sum(pow(balance - m, 2)) / sum(pow(balance - t, 2)), 6) AS within FROM g")
def _(areas):
    groups = areas.groupBy("city").agg(F.count("balance").alias("n"), F.sum("balance").alias("s"), F.sum(F.col("balance") * F.col("balance")).alias("q"))
    total = groups.agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    return total.select("n", "n_groups", r(F.try_divide(F.col("q") - F.col("b"), F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("within"))


@query("t9_partial_correlation", "areas", sql="WITH c AS (SELECT corr(balance, jobs) AS xy, corr(balance, population) AS xz, corr(jobs, population) AS yz FROM areas) SELECT round(xy, 6) AS raw, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c")
def _(areas):
    pair = lambda a, b: reports.safe_corr(F.col(a), F.col(b))
    c = areas.agg(pair("balance", "jobs").alias("xy"), pair("balance", "population").alias("xz"), pair("jobs", "population").alias("yz"))
    return c.select(r("xy").alias("raw"), r(reports.partial_corr(F.col("xy"), F.col("xz"), F.col("yz"))).alias("partial"))


@query("m2_stratified_split", "areas", sql="SELECT geoid, row_number() OVER (PARTITION BY city ORDER BY (id * 7919 + 104729) % 100003, id) <= 0.2 * count(*) OVER (PARTITION BY city) AS held_out FROM areas")
def _(areas):
    drawn = F.row_number().over(Window.partitionBy("city").orderBy((F.col("id") * 7919 + 104729) % 100003, "id"))
    sizes = areas.groupBy("city").agg(F.count("*").alias("n"))
    return areas.withColumn("k", drawn).join(sizes, "city").select("geoid", (F.col("k") <= 0.2 * F.col("n")).alias("held_out"))


@query("e7_within_corr2", "areas", sql="SELECT round(avg(c * c), 6) AS r2 FROM (SELECT corr(balance, jobs) AS c FROM areas GROUP BY city HAVING count(*) > 2) WHERE isfinite(c)")
def _(areas):
    per_city = areas.groupBy("city").agg(F.count("*").alias("n"), reports.safe_corr(F.col("balance"), F.col("jobs")).alias("c"))
    return per_city.where("n > 2 and c is not null").agg(r(F.avg(F.col("c") * F.col("c"))).alias("r2"))


@query("e8_between_level", "areas", sql="SELECT CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS pearson FROM (SELECT avg(balance) AS a, avg(jobs) AS b FROM areas GROUP BY city)")
def _(areas):
    means = areas.groupBy("city").agg(F.avg("balance").alias("a"), F.avg("jobs").alias("b"))
    return means.agg(F.when(F.count("*") >= 3, r(reports.safe_corr(F.col("a"), F.col("b")))).alias("pearson"))


@query("x3_islands", "facilities", sql="SELECT a.id, count(b.id) AS n_neighbours, count(b.id) = 0 AS island FROM facilities a LEFT JOIN facilities b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 36 GROUP BY a.id")
def _(facilities):
    from arealens.operators import spatial

    near = spatial.pairs_within(facilities, facilities, 6.0).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    found = facilities.select("id").join(near, "id", "left").withColumn("n_neighbours", F.coalesce("n", F.lit(0)))
    return found.select("id", "n_neighbours", (F.col("n_neighbours") == 0).alias("island"))


# Rows of the inventory that build on those above


@query("s7_pull", "areas", sql="SELECT geoid AS area_key, population, jobs FROM areas")
def _(areas):
    return areas.select(F.col("geoid").alias("area_key"), "population", "jobs")


@query("s10_stacked_parts", "exposures", sql="SELECT id, line, min(exposure) AS exposure FROM exposures WHERE carrier IN ('A', 'R') GROUP BY id, line")
def _(exposures):
    parts = [exposures.where(F.col("carrier").isin(*kept)) for kept in (("A",), ("R", "A"))]
    # The natural id is not unique in what is loaded, so the row that stays is named.
    return parts[0].unionByName(parts[1]).groupBy("id", "line").agg(F.min("exposure").alias("exposure"))


@query("s11_class_filter", "facilities", sql="SELECT id, kind FROM facilities WHERE kind IN (0, 2)")
def _(facilities):
    path = new_path(facilities.sparkSession, "classes")
    return tables.materialize(facilities.sparkSession, path, lambda: facilities.where(F.col("kind").isin(0, 2)).select("id", "kind"))


@query("p22_constant_columns", "areas", sql="SELECT geoid, jobs, population FROM areas")
def _(areas):
    wide = areas.select("geoid", "jobs", "population", (F.col("jobs") * 0).alias("flat"))
    spread = wide.agg(*[F.stddev(c).alias(c) for c in wide.columns[1:]]).first().asDict()
    return wide.select("geoid", *[c for c, s in spread.items() if s])


@query("j24_near_city", "areas", "facilities", sql="SELECT DISTINCT a.state, f.city FROM areas a JOIN facilities f ON pow(a.x - f.x, 2) + pow(a.y - f.y, 2) <= 4")
def _(areas, facilities):
    from arealens.operators import spatial

    near = spatial.pairs_within(areas, facilities, 2.0)
    named = near.join(areas.select(F.col("id").alias("src"), "state"), "src").join(facilities.select(F.col("id").alias("dst"), "city"), "dst")
    return named.select("state", "city").distinct()


@query("a19_parent_collapse", "exposures", sql="SELECT part // 10 AS parent, round(avg(exposure), 6) AS mean, round(sum(price), 2) AS total, string_agg(DISTINCT carrier, ',' ORDER BY carrier) AS carriers, min(occurred) AS first, max(occurred) AS last, count(DISTINCT carrier) AS n_carriers FROM exposures GROUP BY 1")
def _(exposures):
    found = exposures.groupBy(F.floor(F.col("part") / 10).alias("parent")).agg(
        r(F.avg("exposure")).alias("mean"), r(F.sum("price"), 2).alias("total"), F.array_sort(F.collect_set("carrier")).alias("seen"), F.min("occurred").alias("first"), F.max("occurred").alias("last")
    )
    return found.select("parent", "mean", "total", F.array_join("seen", ",").alias("carriers"), "first", "last", F.size("seen").cast("long").alias("n_carriers"))


@query("a26_pool_inventory", "areas", sql="SELECT city, count(*) AS raw, count(*) FILTER (population > 0) AS kept, sum(population) AS people, round(median(population) FILTER (population > 0), 6) AS mid, round(100.0 * count(*) FILTER (population = 0) / count(*), 6) AS dropped_pct, round(100.0 * count(*) FILTER (population > 0) / sum(count(*) FILTER (population > 0)) OVER (), 6) AS pool_pct FROM areas GROUP BY city")
def _(areas):
    kept = F.col("population") > 0
    found = areas.groupBy("city").agg(F.count("*").alias("raw"), F.count_if(kept).alias("kept"), F.sum("population").alias("people"))
    middle = ranks.medians(areas.where(kept), ["city"], "population", "mid").withColumn("mid", r("mid"))
    found = found.join(middle, "city", "left")
    pool = found.agg(F.sum("kept").alias("pool"))
    share = found.crossJoin(F.broadcast(pool))  # one row
    return share.select("city", "raw", "kept", "people", "mid", r(100.0 * (F.col("raw") - F.col("kept")) / F.col("raw")).alias("dropped_pct"), r(100.0 * F.col("kept") / F.col("pool")).alias("pool_pct"))


@query("a29_weighted_city_means", "areas", sql="WITH c AS (SELECT city, sum(balance * population) / sum(population) AS p, sum(jobs * population) / sum(population) AS o FROM areas GROUP BY city) SELECT round(corr(p, o), 6) AS r, round(avg(p), 6) AS predicted, round(avg(o), 6) AS observed FROM c")
def _(areas):
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("population")), F.sum("population"))
    cities = areas.groupBy("city").agg(mean("balance").alias("p"), mean("jobs").alias("o"))
    return cities.agg(r(reports.safe_corr(F.col("p"), F.col("o"))).alias("r"), r(F.avg("p")).alias("predicted"), r(F.avg("o")).alias("observed"))


@query("a32_aggregate_then_log", "exposures", sql="SELECT agency, round(ln(1 + sum(claims)), 6) AS log_claims FROM exposures GROUP BY agency")
def _(exposures):
    return exposures.groupBy("agency").agg(r(F.log1p(F.sum("claims"))).alias("log_claims"))


@query("w1_latest_of_each", "incidents", sql="SELECT area_id, id, amount FROM incidents QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY occurred DESC, id) = 1")
def _(incidents):
    return incidents.groupBy("area_id").agg(F.max_by(F.struct("id", "amount"), F.struct("occurred", -F.col("id"))).alias("top")).select("area_id", "top.id", "top.amount")


@query("w8_lift", "incidents", sql="WITH a AS (SELECT area_id, cast(sum(amount * 100) AS bigint) AS v FROM incidents GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY v DESC, area_id) AS k, count(*) OVER () AS n, v FROM a) SELECT p AS top_pct, round(sum(v) FILTER (100 * k <= p * n) / sum(v), 6) AS share FROM o, unnest([5, 10, 20, 30, 50]) AS t(p) GROUP BY p")
def _(incidents):
    sums = incidents.groupBy("area_id").agg(F.sum(F.col("amount") * 100).cast("decimal(38,6)").alias("v"))
    sums = sums.select("area_id", F.round("v").cast("long").alias("v"))
    total = sums.agg(F.count("*").alias("n"), F.sum("v").alias("all"), F.max("v").alias("top"))
    # Ranks are counted within 1,024 ranges of the value and then over the ranges.
    ranges = F.floor((F.col("top") - F.col("v")) * 1023 / F.greatest("top", F.lit(1)))
    spread = sums.crossJoin(F.broadcast(total)).select("area_id", "v", (-F.col("v")).alias("down"), ranges.alias("range"), F.lit(1).alias("one"))  # one row
    placed = ranks.running_sum(spread, [], ["down", "area_id"], "one", "before", chunk=F.col("range")).select("v", (F.col("before") + 1).alias("k"))
    shares = placed.crossJoin(F.broadcast(total)).withColumn("top_pct", F.explode(F.array(*[F.lit(p) for p in (5, 10, 20, 30, 50)])))
    return shares.groupBy("top_pct").agg(r(F.sum(F.when(100 * F.col("k") <= F.col("top_pct") * F.col("n"), F.col("v"))) / F.max("all")).alias("share"))


@query("f10_city_anchor", "areas", sql="SELECT geoid, round(ln(1 + sum(jobs) OVER (PARTITION BY city)), 6) AS anchor FROM areas")
def _(areas):
    levels = areas.groupBy("city").agg(F.log1p(F.sum("jobs")).alias("anchor"))
    return areas.join(levels, "city").select("geoid", r("anchor").alias("anchor"))


@query("f12_proxies", "incidents", sql="SELECT id, round(ln(1 + coalesce(x, 0) + coalesce(y, 0)), 6) AS proxy, CASE WHEN x IS NULL THEN NULL ELSE x > 50 END AS flag FROM incidents")
def _(incidents):
    return incidents.select("id", r(F.log1p(F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)))).alias("proxy"), (F.col("x") > 50).alias("flag"))


@query("f14_overnight", "incidents", sql="SELECT id, (id % 30) * 3600 + (id % 60) * 60 AS seconds, ((id % 30) * 60 + id % 60) % 1440 >= 1320 OR ((id % 30) * 60 + id % 60) % 1440 < 300 AS overnight FROM incidents")
def _(incidents):
    clock = incidents.select("id", F.format_string("%02d:%02d:00", F.col("id") % 30, F.col("id") % 60).alias("at"))
    part = lambda k: F.split("at", ":")[k].cast("long")
    timed = clock.select("id", (part(0) * 3600 + part(1) * 60 + part(2)).alias("seconds"))
    hour = F.pmod(F.col("seconds") / 3600, F.lit(24.0))
    return timed.select("id", "seconds", ((hour >= 22) | (hour < 5)).alias("overnight"))


@query("f22_rate_of_change", "areas", sql="WITH a AS (SELECT geoid, state, CASE WHEN population > 0 THEN jobs / population END AS v FROM areas), f AS (SELECT geoid, coalesce(v, avg(v) OVER (PARTITION BY state), avg(v) OVER ()) AS v FROM a), m AS (SELECT avg(v) AS m FROM f) SELECT geoid, round(least(m + 2 * abs(m), greatest(m - 2 * abs(m), v)), 6) AS rate FROM f, m")
def _(areas):
    rates = areas.select("geoid", "state", F.try_divide("jobs", "population").alias("v"))
    states, nation = rates.groupBy("state").agg(F.avg("v").alias("s")), rates.agg(F.avg("v").alias("n"))
    filled = rates.join(states, "state", "left").crossJoin(F.broadcast(nation)).select("geoid", F.coalesce("v", "s", "n").alias("v"))
    mean, room = F.col("m"), 2 * F.abs("m")
    clamped = filled.crossJoin(F.broadcast(filled.agg(F.avg("v").alias("m"))))  # one row
    return clamped.select("geoid", r(F.least(mean + room, F.greatest(mean - room, F.col("v")))).alias("rate"))


@query("f24_crosswalk", "exposures", sql="SELECT agency, round(sum(claims * exposure) / sum(exposure), 6) AS moved FROM exposures GROUP BY agency")
def _(exposures):
    weight = F.col("exposure").cast("double")
    return exposures.groupBy("agency").agg(r(F.try_divide(F.sum(F.col("claims") * weight), F.sum(weight))).alias("moved"))


@query("f25_fixed_scorer", "areas", sql="WITH s AS (SELECT geoid, population, jobs, pow(10, 0.2 + 0.001 * jobs + 0.0001 * population) AS p FROM areas), k AS (SELECT (sum(jobs * population) / sum(population)) / (sum(p * population) / sum(population)) AS k FROM s) SELECT geoid, round(p * k, 5) AS score FROM s, k")
def _(areas):
    coefficients = {"jobs": 0.001, "population": 0.0001}
    scored = areas.withColumn("p", F.pow(F.lit(10.0), sum((F.col(c) * b for c, b in coefficients.items()), F.lit(0.2))))
    scale = scored.agg(F.try_divide(F.sum(F.col("jobs") * F.col("population")), F.sum(F.col("p") * F.col("population"))).alias("k"))
    return scored.crossJoin(F.broadcast(scale)).select("geoid", r(F.col("p") * F.col("k"), 5).alias("score"))


@query("f26_low_tail", "areas", sql="WITH s AS (SELECT geoid, balance / 1e3 AS p FROM areas), m AS (SELECT min(p) AS m FROM s) SELECT geoid, round(CASE WHEN p < 0.5 THEN (p - m) / (0.5 - m) ELSE p END, 6) AS p FROM s, m")
def _(areas):
    scored = areas.select("geoid", (F.col("balance") / 1e3).alias("p"))
    low = scored.agg(F.min("p").alias("m"))
    return scored.crossJoin(F.broadcast(low)).select("geoid", r(F.when(F.col("p") < 0.5, (F.col("p") - F.col("m")) / (0.5 - F.col("m"))).otherwise(F.col("p"))).alias("p"))


@query("f27_true_up", "areas", sql="WITH c AS (SELECT *, sum(jobs) OVER (PARTITION BY city) / nullif(sum(population) OVER (PARTITION BY city), 0) AS parent FROM areas), u AS (SELECT *, CASE WHEN population < 200 THEN parent ELSE balance / 1e3 END AS v FROM c), k AS (SELECT city, max(parent) * sum(population) / nullif(sum(v * population), 0) AS k FROM u WHERE population >= 200 GROUP BY city) SELECT geoid, round(CASE WHEN population < 200 THEN v ELSE v * k END, 6) AS v FROM u LEFT JOIN k USING (city)")
def _(areas):
    parents = areas.groupBy("city").agg(F.try_divide(F.sum("jobs"), F.sum("population")).alias("parent"))
    tiny = F.col("population") < 200
    used = areas.join(parents, "city").withColumn("v", F.when(tiny, F.col("parent")).otherwise(F.col("balance") / 1e3))
    scale = used.where(~tiny).groupBy("city").agg(F.try_divide(F.max("parent") * F.sum("population"), F.sum(F.col("v") * F.col("population"))).alias("k"))
    return used.join(scale, "city", "left").select("geoid", r(F.when(tiny, F.col("v")).otherwise(F.col("v") * F.col("k"))).alias("v"))


@query("f29_families", "part", sql="SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type LIKE '%BRASS' THEN 'brass' WHEN p_type LIKE '%STEEL' THEN 'steel' ELSE 'other' END AS family FROM part")
def _(part):
    kind = F.col("p_type")
    return part.select("p_partkey", F.when(kind.startswith("PROMO"), "promo").when(kind.endswith("BRASS"), "brass").when(kind.endswith("STEEL"), "steel").otherwise("other").alias("family"))


@query("f31_shares", "areas", sql="SELECT geoid, round(CASE WHEN population = 0 THEN 0 ELSE jobs / population END, 6) AS share, CASE WHEN segment IS NULL OR segment = 'BUILDING' THEN concat('C', cast(city AS varchar)) ELSE segment END AS code FROM areas")
def _(areas):
    share = F.when(F.col("population") == 0, F.lit(0.0)).otherwise(F.try_divide("jobs", "population"))
    return areas.select("geoid", r(share).alias("share"), F.when(F.col("segment").isNull() | (F.col("segment") == "BUILDING"), F.concat(F.lit("C"), "city")).otherwise(F.col("segment")).alias("code"))


@query("f32_block_fill", "incidents", sql="SELECT id, CASE WHEN status = 'F' AND y IS NOT NULL THEN coalesce(x, 0) ELSE x END AS x FROM incidents")
def _(incidents):
    return incidents.select("id", F.when((F.col("status") == "F") & F.col("y").isNotNull(), F.coalesce("x", F.lit(0.0))).otherwise(F.col("x")).alias("x"))


@query("t5_target_correlations", "areas", sql="SELECT unnest(['jobs', 'population']) AS candidate, round(unnest([corr(balance, jobs), corr(balance, population)]), 6) AS r FROM areas")
def _(areas):
    return reports.correlations(areas, ["balance", "jobs", "population"]).where("a = 'balance'").select(F.col("b").alias("candidate"), r("r").alias("r"))


CITY_FIT = "count(*) AS n, round(1 - sum(pow(jobs - population / 5, 2)) / nullif(sum(jobs * jobs) - sum(jobs) * sum(jobs) / count(*), 0), 6) AS r2, round(avg(abs(jobs - population / 5)), 6) AS mae FROM areas"


@query("e3_city_scores", "areas", sql=f"SELECT cast(city AS varchar) AS city, {CITY_FIT} GROUP BY city UNION ALL SELECT 'POOLED', {CITY_FIT}")
def _(areas):
    y, p = F.col("jobs"), F.col("population") / 5
    sums = areas.groupBy("city").agg(F.count("*").alias("n"), F.sum(F.pow(y - p, F.lit(2))).alias("e"), F.sum(y * y).alias("q"), F.sum("jobs").alias("s"), F.sum(F.abs(y - p)).alias("m"))
    total = sums.groupBy().agg(*[F.sum(c).alias(c) for c in ("n", "e", "q", "s", "m")]).select(F.lit("POOLED").alias("city"), "n", "e", "q", "s", "m")
    rows = sums.withColumn("city", F.col("city").cast("string")).unionByName(total)
    return rows.select("city", "n", r(1 - F.try_divide(F.col("e"), F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("r2"), r(F.col("m") / F.col("n")).alias("mae"))


@query("e10_fit_decomposition", "areas", sql="SELECT city, round(avg(jobs - balance), 4) AS shift, round(stddev_samp(jobs), 4) AS sd_y, round(stddev_samp(balance), 4) AS sd_p, round(pow(corr(jobs, balance), 2), 6) AS corr2 FROM areas GROUP BY city HAVING count(*) > 2")
def _(areas):
    found = areas.groupBy("city").agg(F.count("*").alias("n"), r(F.avg(F.col("jobs") - F.col("balance")), 4).alias("shift"), r(F.stddev("jobs"), 4).alias("sd_y"), r(F.stddev("balance"), 4).alias("sd_p"), r(F.pow(reports.safe_corr(F.col("jobs"), F.col("balance")), F.lit(2))).alias("corr2"))
    return found.where("n > 2").drop("n")
