"""From feed tables to area predictors: active services of a day, stops with their service, risk flags at the stop, densities and distances of areas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealens.functions.columns import parse_service_time
from arealens.operators.aggregates import equitability
from arealens.operators.overlay import ring_measures
from arealens.operators.spatial import nearest, pairs_within, points_in_polygons

#: Fixed: the members of a feed that are read, and the columns taken from each; others are left unread.
MEMBERS = {
    "stops": ("stop_id", "stop_lon", "stop_lat", "parent_station"),
    "routes": ("route_id", "route_type"),
    "trips": ("trip_id", "route_id", "service_id"),
    "stop_times": ("trip_id", "stop_id", "departure_time", "arrival_time"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "frequencies": ("trip_id", "start_time", "end_time", "headway_secs"),
}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NIGHT_ENDS, MIDNIGHT = 5 * 3600, 24 * 3600  # fixed: service before five or from midnight on is overnight


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The members of an unpacked feed as tables of trimmed strings; a member or column that the feed lacks is there, empty or null."""
    jvm = spark.sparkContext._jvm
    out = {}
    for name, columns in MEMBERS.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raw = spark.read.csv(f"{folder}/{name}.txt", header=True)
            raw = raw.toDF(*[c.strip("﻿ ").lower() for c in raw.columns])
        else:
            raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        out[name] = feed_table(raw, name)
    return out


def feed_table(raw: DataFrame, name: str) -> DataFrame:
    """The member's own columns of a table as trimmed strings, null where they are blank or absent."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return raw.select(*[(blank(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in MEMBERS[name]])


def service_days(feed: Mapping[str, DataFrame]) -> DataFrame:
    """(service_id, day) of every day that a service runs: its weekdays from start to end, less removed dates (exception 2), and added ones (1)."""
    date = lambda c: F.expr(f"try_to_timestamp({c}, 'yyyyMMdd')").cast("date")
    spans = feed["calendar"].withColumns({"_a": date("start_date"), "_b": date("end_date")}).where("_a <= _b")
    days = spans.select("service_id", *DAYS, F.explode(F.sequence("_a", "_b")).alias("day"))
    runs = F.element_at(F.array(*[F.coalesce(F.col(d) == "1", F.lit(False)) for d in DAYS]), F.weekday("day") + 1)
    changes = feed["calendar_dates"].select("service_id", date("date").alias("day"), "exception_type").where("day is not null").distinct()
    regular = days.where(runs).select("service_id", "day").distinct()
    removed = changes.where("exception_type = '2'").select("service_id", "day")
    added = changes.where("exception_type = '1'").select("service_id", "day")
    return regular.join(removed, ["service_id", "day"], "left_anti").unionByName(added).distinct()


def service_day(feed: Mapping[str, DataFrame], anchor: str, share: float = 0.8) -> DataFrame:
    """(day): of the weekdays with service (of all days if none is a weekday), those with at least ``share`` of the most trips of any, the one
    nearest to ``anchor``, the earlier of two; no row without service."""
    trips = feed["trips"].groupBy("service_id").agg(F.count("*").alias("_n"))
    daily = service_days(feed).join(trips, "service_id", "left").groupBy("day").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_n"))
    daily = daily.withColumn("_week", F.weekday("day") < 5)
    most = daily.agg(F.max("_week").alias("_any"), F.max(F.when(F.col("_week"), F.col("_n"))).alias("_m"), F.max("_n").alias("_all"))
    pool = daily.crossJoin(F.broadcast(most)).where("_week = _any")  # one row
    strong = pool.where(F.col("_n") >= share * F.when(F.col("_any"), F.col("_m")).otherwise(F.col("_all")))
    return strong.agg(F.min(F.struct(F.abs(F.datediff("day", F.lit(anchor).cast("date"))).alias("far"), "day"))["day"].alias("day")).where("day is not null")


def stop_service(feed: Mapping[str, DataFrame], day: DataFrame) -> DataFrame:
    """(stop_id, x, y, n_trips, first_s, last_s, overnight, route_types) of every stop with a place; stops without times that day have 0 trips.

    ``day`` is one row. Times may run past 24:00. A trip with frequencies counts as often as it runs. overnight: the first time is before five or the
    last is from midnight on.
    """
    active = service_days(feed).join(F.broadcast(day), "day").select("service_id")
    trips = feed["trips"].join(active, "service_id", "left_semi").join(feed["routes"], "route_id", "left").select("trip_id", F.expr("try_cast(route_type AS int)").alias("route_type"))
    span = parse_service_time(F.col("end_time")) - parse_service_time(F.col("start_time"))
    often = feed["frequencies"].groupBy("trip_id").agg(F.sum(F.greatest(F.floor(F.try_divide(span.cast("double"), F.expr("try_cast(headway_secs AS double)"))), F.lit(1))).alias("_runs"))
    late = feed["frequencies"].groupBy("trip_id").agg(F.min(parse_service_time(F.col("start_time"))).alias("_from"), F.max(parse_service_time(F.col("end_time"))).alias("_to"))
    second = F.coalesce(parse_service_time(F.col("departure_time")), parse_service_time(F.col("arrival_time")))
    times = feed["stop_times"].select("trip_id", "stop_id", second.alias("_s")).join(trips, "trip_id").join(often, "trip_id", "left").join(late, "trip_id", "left")
    # A trip with frequencies repeats from its first start to its last end.
    service = times.groupBy("stop_id").agg(
        F.sum(F.coalesce("_runs", F.lit(1))).cast("long").alias("n_trips"), F.min(F.coalesce("_from", "_s")).alias("first_s"), F.max(F.coalesce("_to", "_s")).alias("last_s"), F.array_sort(F.collect_set("route_type")).alias("route_types")
    )
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    stops = feed["stops"].select("stop_id", number("stop_lon").alias("x"), number("stop_lat").alias("y")).where("x is not null and y is not null")
    overnight = F.coalesce((F.col("first_s") < NIGHT_ENDS) | (F.col("last_s") >= MIDNIGHT), F.lit(False))
    joined = stops.join(service, "stop_id", "left").withColumn("overnight", overnight)
    return joined.withColumns({"n_trips": F.coalesce("n_trips", F.lit(0).cast("long")), "route_types": F.coalesce("route_types", F.array().cast("array<int>"))})


def risk_flags(stops: DataFrame, facilities: DataFrame, radius: float) -> DataFrame:
    """``stops`` with near_risky (a facility of any kind within ``radius``) and risky_allnight (that, and overnight at this very stop)."""
    near = pairs_within(stops.select(F.col("stop_id").alias("id"), "x", "y"), facilities.select("id", "x", "y").where("x is not null and y is not null"), radius)
    flagged = near.select(F.col("src").alias("stop_id")).distinct().withColumn("near_risky", F.lit(True))
    joined = stops.join(flagged, "stop_id", "left").withColumn("near_risky", F.coalesce("near_risky", F.lit(False)))
    return joined.withColumn("risky_allnight", F.col("near_risky") & F.col("overnight"))


def area_transit(areas: DataFrame, stops: DataFrame, cell: float) -> DataFrame:
    """One row for each area (geoid, ring): counts, shares and density of its stops, diversity of route types, and the distance of its centroid to any stop.

    ``stops`` are those of ``risk_flags``. Areas without stops have zeros, and the distance all the same; it is infinite without stops.
    """
    placed = points_in_polygons(stops, areas.select("geoid", "ring"), "x", "y", "ring", cell)
    count: Column = F.count("*")
    share = lambda c: F.avg(F.col(c).cast("double"))
    sums = placed.groupBy("geoid").agg(
        count.alias("stop_count"), F.sum("n_trips").alias("service_intensity"), F.count_if("overnight").alias("overnight_count"), share("overnight").alias("overnight_share"),
        F.count_if("near_risky").alias("risky_count"), share("near_risky").alias("risky_share"), F.count_if("risky_allnight").alias("risky_allnight_count"),
    )
    modes = equitability(placed.select("geoid", F.explode("route_types").alias("mode")), "geoid", "mode").select("geoid", F.col("equitability").alias("mode_diversity"))
    shape = areas.withColumn("_m", ring_measures(F.col("ring"))).select("geoid", F.col("_m.area").alias("_area"), F.col("_m.cx").alias("x"), F.col("_m.cy").alias("y"))
    far = nearest(shape.select(F.col("geoid").alias("id"), "x", "y"), stops.select(F.col("stop_id").alias("id"), "x", "y"), cell).select(F.col("id").alias("geoid"), F.col("dist").alias("nearest_stop"))
    joined = shape.drop("x", "y").join(sums, "geoid", "left").join(modes, "geoid", "left").join(far, "geoid", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(dict(joined.dtypes)[c])) for c in [*sums.columns[1:], "mode_diversity"]}
    joined = joined.withColumns(zero)
    return joined.withColumn("stop_density", F.coalesce(F.try_divide(F.col("stop_count").cast("double"), F.col("_area")), F.lit(0.0))).drop("_area")


def transit_build(feed: Mapping[str, DataFrame], facilities: DataFrame, areas: DataFrame, radius: float, cell: float, anchor: str) -> DataFrame:
    """Area predictors of one feed from its tables: service of a full weekday near ``anchor``, stops' risk flags, then areas."""
    return area_transit(areas, risk_flags(stop_service(feed, service_day(feed, anchor)), facilities, radius), cell)
