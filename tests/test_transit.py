"""Feeds read from their members, service days, stops and the areas built from them."""

from pyspark.sql import functions as F

from arealens.operators import transit

FILES = {
    "stops": "﻿stop_id,stop_name,stop_lat,stop_lon\na,A,1,1\n b ,B,1,11\nc,C,,\nd,D,1,1.5\n",
    "routes": "route_id,route_type\nr1,3\nr2,1\n",
    "trips": "route_id,service_id,trip_id\nr1, 1,t1\nr1,1,t2\nr2,2,t3\nr2,9,t4\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id\nt1,08:00:00,08:00:00,a\nt2,25:10:00,,a\nt3,04:59:00,04:59:00,b\nt4,09:00:00,09:00:00,d\nt1,bad,09:00:00,b\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n1 ,1,1,1,1,1,0,0,20240101,20240114 \n2,0,0,0,0,0,1,1,20240101,20240114\n",
    "calendar_dates": "service_id,date,exception_type\n1,20240103,2\n2,20240104,1\n9,20240301,1\n",
}


def feed_of(spark, folder, names):
    for n in names:
        (folder / f"{n}.txt").write_text(FILES[n])
    return transit.read_feed(spark, str(folder))


def test_feed_to_areas(spark, tmp_path):
    feed = feed_of(spark, tmp_path, FILES)
    assert set(feed) == set(transit.MEMBERS) and feed["frequencies"].count() == 0
    days = {(r["service_id"], str(r["day"])) for r in transit.service_days(feed).collect()}
    assert ("1", "2024-01-03") not in days and ("2", "2024-01-04") in days and ("9", "2024-03-01") in days
    # Thursday the 4th has all three trips; other weekdays have two, under 80 % of it.
    day = transit.service_day(feed, "2024-01-12")
    assert str(day.first()["day"]) == "2024-01-04"
    stops = {r["stop_id"]: r for r in transit.stop_service(feed, day).collect()}
    assert set(stops) == {"a", "b", "d"}
    assert (stops["a"]["n_trips"], stops["a"]["overnight"], stops["a"]["last_s"]) == (2, True, 90600)
    assert (stops["b"]["n_trips"], stops["b"]["overnight"], stops["b"]["route_types"]) == (2, True, [1, 3])
    assert (stops["d"]["n_trips"], stops["d"]["overnight"], stops["d"]["first_s"], stops["d"]["route_types"]) == (0, False, None, [])
    facilities = spark.createDataFrame([(1, 1.2, 1.0), (2, None, 1.0)], "id long, x double, y double")
    square = lambda west: F.array(*[F.struct(F.lit(west + x).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0.0, 0), (10.0, 0), (10.0, 10), (0.0, 10), (0.0, 0))])
    areas = spark.range(1).select(F.lit("w").alias("geoid"), square(0.0).alias("ring")).unionByName(spark.range(1).select(F.lit("e").alias("geoid"), square(10.0).alias("ring"))).unionByName(spark.range(1).select(F.lit("far").alias("geoid"), square(90.0).alias("ring")))
    rows = {r["geoid"]: r for r in transit.transit_build(feed, facilities, areas, 0.5, 5.0, "2024-01-12").collect()}
    assert (rows["w"]["stop_count"], rows["w"]["risky_count"], rows["w"]["risky_allnight_count"], rows["w"]["service_intensity"]) == (2, 2, 1, 2)
    assert (rows["e"]["overnight_share"], rows["e"]["risky_share"], rows["e"]["mode_diversity"], rows["e"]["stop_density"]) == (1.0, 0.0, 1.0, 0.01)
    assert (rows["far"]["stop_count"], rows["far"]["overnight_share"]) == (0, 0.0) and round(rows["far"]["nearest_stop"], 3) == round((84**2 + 16) ** 0.5, 3)


def test_feeds_without_service_or_stops(spark, tmp_path):
    feed = feed_of(spark, tmp_path, ["stops"])
    assert transit.service_day(feed, "2024-01-12").count() == 0
    assert {r["n_trips"] for r in transit.stop_service(feed, transit.service_day(feed, "2024-01-12")).collect()} == {0}
    empty = {k: v.limit(0) for k, v in feed.items()}
    areas = spark.createDataFrame([("w", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])], "geoid string, ring array<struct<x: double, y: double>>")
    facilities = spark.createDataFrame([], "id long, x double, y double")
    (row,) = transit.transit_build(empty, facilities, areas, 0.5, 5.0, "2024-01-12").collect()
    assert row["stop_count"] == 0 and row["nearest_stop"] == float("inf")


def test_weekend_services_are_taken_where_no_weekday_has_any(spark, tmp_path):
    feed = feed_of(spark, tmp_path, [k for k in FILES if k != "calendar_dates"])
    feed["calendar"] = feed["calendar"].where("service_id = '2'")
    assert str(transit.service_day(feed, "2024-01-12").first()["day"]) == "2024-01-13"
