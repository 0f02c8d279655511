"""Hand-made cases at the boundaries of the rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import hexgrid
from waymark.functions.geo import haversine_m
from waymark.functions.scalars import (
    batch_score,
    clip,
    hour_of_text,
    iso_text,
    json_number,
    ratio,
    risk_level,
    version_tag,
)
from waymark.operators.changes import apply_changes, rejected_changes
from waymark.plans import anomalies, heatmap, routes, scoring, tracking, zones
from waymark.schemas import TABLES
from waymark.sources import jdbc, scans

DAY = dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc)
AS_OF = "2024-01-31T00:00:00+00:00"


def values(df, column):
    return [row[column] for row in df.collect()]


def positions(spark, rows):
    """rows: (id, device, seconds, lat, lon, speed)"""
    data = [
        (i, d, DAY + dt.timedelta(seconds=s), lat, lon, speed, None, None, None, None, None)
        for i, d, s, lat, lon, speed in rows
    ]
    return spark.createDataFrame(data, TABLES["positions"])


def test_risk_bounds(spark):
    df = spark.createDataFrame([(0, 0.39), (1, 0.4), (2, 0.64), (3, 0.65), (4, None)], "i int, s double")
    got = values(df.orderBy("i").select(risk_level(F.col("s")).alias("r")), "r")
    assert got == ["low", "medium", "medium", "high", "unknown"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 250.0), (2, 251.0), (3, None)], "i int, s double")
    assert values(df.orderBy("i").select(clip(F.col("s"), 0.0, 250.0).alias("r")), "r") == [0.0, 250.0, 250.0, None]


def test_batch_score(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.6), (2, -0.6), (3, -0.12345)], "i int, d double")
    assert values(df.orderBy("i").select(batch_score(F.col("d")).alias("r")), "r") == [0.5, 0.0, 1.0, 0.6235]


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (10.0, 20.0, None, 20.0), (0.0, 0.0, 0.0, 180.0)],
                               "a double, b double, c double, d double")
    got = values(df.select(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")), "m")
    assert got[0] == pytest.approx(6371000 * math.pi / 180)
    assert got[1] is None
    assert got[2] == pytest.approx(6371000 * math.pi)


def test_hour_of_text(spark):
    df = spark.createDataFrame(
        [(0, "2024-01-05T13:10:00+00:00"), (1, "bad"), (2, None), (3, "2024-01-05 07:00:00")], "i int, s string"
    )
    assert values(df.orderBy("i").select(hour_of_text(F.col("s")).alias("h")), "h") == [13, 0, 0, 7]


def test_text_forms(spark):
    df = spark.createDataFrame([(DAY, 7)], "t timestamp, d bigint")
    row = df.select(iso_text(F.col("t")).alias("iso"), version_tag(F.to_date("t"), F.col("d")).alias("tag")).first()
    assert row["iso"] == "2024-01-05T00:00:00.000000Z"
    assert row["tag"] == "20240105_7"


def test_ratio_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "a bigint, b bigint")
    assert sorted(values(df.select(ratio(F.col("a"), F.col("b"), 4).alias("r")), "r")) == [0.0, 0.3333]


def test_event_location(spark):
    df = spark.createDataFrame(
        [
            (0, '{"latitude": 0, "lat": 5}'),
            (1, '{"latitude": -17.5}'),
            (2, '{"lat": "-3.25"}'),
            (3, '{"lat": ""}'),
            (4, '{"lat": "x"}'),
            (5, None),
            (6, "not json"),
        ],
        "i int, m string",
    )
    got = values(df.orderBy("i").select(json_number(F.col("m"), "latitude", "lat").alias("v")), "v")
    assert got == [5.0, -17.5, -3.25, None, None, None, None]


def test_alert_weights(spark):
    rows = [(i, 1, "t", s, '{"lat": -17.0, "lon": -63.0}', DAY, False) for i, s in enumerate(["high", "critical", "low"])]
    alerts = spark.createDataFrame(rows, TABLES["alerts"])
    got = heatmap.alert_source(alerts, AS_OF)
    assert sorted(values(got, "weight")) == [0.4, 0.4, 0.8]
    assert set(values(got, "type")) == {"alert_t"}


def test_missing_event_type_is_named(spark):
    events = spark.createDataFrame(
        [(1, 1, None, 1, DAY, '{"lat": 1.5, "lon": 2.5}')], TABLES["device_events"]
    )
    assert values(heatmap.event_source(events, AS_OF), "type") == ["event_None"]


def test_intensity(spark):
    totals = spark.createDataFrame([(0, 0, 11.7, 117), (1, 0, 0.5, 1), (2, 0, 0.1, 1)],
                                   "q bigint, r bigint, total_weight double, event_count bigint")
    got = {row["h3_cell"]: row["intensity"] for row in heatmap.intensities(totals).collect()}
    assert got == {"8:0:0": 1.0, "8:1:0": 0.1595}


def test_weightless_heatmap_is_empty(spark):
    totals = spark.createDataFrame([(0, 0, 0.0, 1), (1, 0, None, 2)],
                                   "q bigint, r bigint, total_weight double, event_count bigint")
    assert heatmap.intensities(totals).count() == 0


def test_zone_cells_raise_and_add(spark):
    totals = spark.createDataFrame([(0, 0, 2.0, 4), (1, 0, 2.0, 3)],
                                   "q bigint, r bigint, total_weight double, event_count bigint")
    cells = spark.createDataFrame([(0, 0), (5, 5)], "q bigint, r bigint")
    got = {(r["q"], r["r"]): (r["total_weight"], r["event_count"]) for r in heatmap.with_risk_zones(totals, cells).collect()}
    assert got == {(0, 0): (3.0, 4), (1, 0): (2.0, 3), (5, 5): (0.5, 1)}


@pytest.mark.parametrize("resolution", [5, 8, 11])
def test_centres_fall_in_their_cell(spark, resolution):
    cells = spark.range(-300, 300).selectExpr("id * 37 as q", "id * 11 - 40 as r")
    # rows beyond the poles do not exist
    cells = cells.where(F.abs("r") * 1.5 * hexgrid.hex_size(resolution) < 6_371_000)
    lat, lon = hexgrid.cell_center(F.col("q"), F.col("r"), resolution)
    back = cells.select("q", "r", lat.alias("lat"), lon.alias("lon"))
    q, r = hexgrid.cell_of(F.col("lat"), F.col("lon"), resolution)
    assert back.select(((q == F.col("q")) & (r == F.col("r"))).alias("ok")).where("not ok").count() == 0


def test_spike_removes_itself_and_the_next_point(spark):
    rows = [(1, 1, 0, -17.0, -63.0, 5.0), (2, 1, 10, -16.5, -63.0, 5.0), (3, 1, 20, -17.0, -63.0, 5.0)]
    points = routes.route_points(positions(spark, rows))
    assert values(points, "id") == [1]
    assert values(points, "dist_from_prev") == [0.0]


def test_medians_come_from_before_the_teleport_filter(spark):
    rows = [(1, 1, 0, -17.0, -63.0, None), (2, 1, 10, -16.5, -63.0, 90.0), (3, 1, 20, -17.0, -63.0, 30.0),
            (4, 1, 30, -17.0, -63.0, 10.0)]
    points = routes.route_points(positions(spark, rows))
    assert {r["id"]: r["speed"] for r in points.collect()} == {1: 30.0, 4: 10.0}


def test_steps_cross_empty_hours_but_not_midnight(spark):
    rows = [(1, 1, 0, -17.0, -63.0, 1.0), (2, 1, 5 * 3600, -17.001, -63.0, 1.0), (3, 1, 86400, -17.002, -63.0, 1.0)]
    got = {r["id"]: round(r["dist_from_prev"], 1) for r in routes.route_points(positions(spark, rows)).collect()}
    assert got == {1: 0.0, 2: 111.2, 3: 0.0}


def test_route_needs_five_points(spark):
    rows = [(i, 1, i, -17.0, -63.0, 1.0) for i in range(4)] + [(i, 2, i, -17.0, -63.0, None) for i in range(10, 15)]
    points = routes.route_points(positions(spark, rows))
    summary = routes.summarise_routes(points).collect()
    assert [(r["device_id"], r["point_count"], r["avg_speed"]) for r in summary] == [(2, 5, 0.0)]
    assert values(routes.skipped_days(points), "device_id") == [1]
    segments = routes.route_segments(points).collect()
    assert [len(r["points"]) for r in segments] == [5]
    assert segments[0]["points"][0]["speed"] is None


def test_segments_are_bounded(spark):
    rows = [(i, 1, i, -17.0, -63.0, 1.0) for i in range(2500)]
    segments = routes.route_segments(routes.route_points(positions(spark, rows))).orderBy("segment").collect()
    assert [len(r["points"]) for r in segments] == [1000, 1000, 500]
    times = [p["recorded_at"] for r in segments for p in r["points"]]
    assert times == sorted(times)


def test_open_day_is_aggregated_on_demand(spark):
    rows = [(i, 1, i, -17.0, -63.0, 1.0) for i in range(6)] + [(i, 2, i, -17.0, -63.0, 1.0) for i in range(10, 16)]
    table = positions(spark, rows)
    stored = spark.createDataFrame([(1, DAY.date(), 99, 1.0, 1.0, DAY)], TABLES["daily_routes"])
    today = routes.route_of_day(table, stored, "2024-01-05T12:00:00+00:00", "2024-01-05")
    assert {r["device_id"]: r["point_count"] for r in today.collect()} == {1: 99, 2: 6}
    later = routes.route_of_day(table, stored, "2024-01-06T12:00:00+00:00", "2024-01-05")
    assert {r["device_id"]: r["point_count"] for r in later.collect()} == {1: 99}


def test_slow_filter(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.01), (3, None)], "id int, speed double")
    assert sorted(values(zones.slow_points(df), "id")) == [1, 3]


def test_group_minimum(spark):
    df = spark.createDataFrame([(1,)] * 15 + [(2,)] * 16, "device_id bigint")
    assert set(values(zones.enough_points(df, 16), "device_id")) == {2}


def test_anomalous_places_are_left_out(spark):
    points = spark.createDataFrame([(1, -17.000001, -63.0), (1, -17.1, -63.0), (2, -17.0, -63.0)],
                                   "device_id bigint, latitude double, longitude double")
    flagged = spark.createDataFrame(
        [(1, 1, -17.000002, -63.0, 0.9, True, DAY, None), (2, 1, -17.1, -63.0, 0.9, False, DAY, None),
         (3, 2, -17.0, -63.0, 0.9, True, DAY - dt.timedelta(days=400), None)], TABLES["anomalies"])
    got = zones.without_anomalies(points, flagged, AS_OF, 30)
    assert sorted((r["device_id"], r["latitude"]) for r in got.collect()) == [(1, -17.1), (2, -17.0)]


def test_stops_at_rounding_edges(spark):
    """Points that share a place at 5 decimals but not at 4 both stay; a flagged first point hands over."""
    rows = [(0, 0.000049), (1, 0.000051), (2, 0.00102), (3, 0.00104)]
    point = [(lat, -63.0, 1.0, DAY + dt.timedelta(seconds=s)) for s, lat in rows]
    segments = spark.createDataFrame([(1, DAY.date(), 0, 0, point)], TABLES["route_segments"])
    flagged = spark.createDataFrame([(1, 1, 0.00102, -63.0, 0.9, True, DAY, None)], TABLES["anomalies"])
    got = zones.stop_points(segments, flagged, AS_OF, 30)
    assert sorted(values(got, "latitude")) == [0.000049, 0.000051, 0.00104]


@pytest.mark.parametrize(
    "label, distance, zone, score, anomaly, risk",
    [
        (-1, 6000.0, "secondary", 0.9, True, "high"),
        (-1, None, None, 0.5, False, "medium"),
        (1, 6000.0, "secondary", 0.4, False, "medium"),
        (-1, 100.0, "main", 0.0, False, "low"),
        (-1, 100.0, "secondary", 0.2, False, "low"),
        (-1, 200.0, None, 0.2, False, "low"),
        (-1, 201.0, "main", 0.5, False, "medium"),
        (-1, 3000.0, "main", 0.7, True, "high"),
        (-1, 2000.0, "main", 0.5, False, "medium"),
        (-1, 5000.0, "main", 0.7, True, "high"),
        (1, 1.0, "main", 0.0, False, "low"),
        (None, 6000.0, "main", None, False, "unknown"),
    ],
)
def test_additive_score(spark, label, distance, zone, score, anomaly, risk):
    schema = "label int, min_distance double, nearest_cluster_label string, inside_cluster boolean"
    inside = None if distance is None else distance <= 200
    row = scoring.additive_score(spark.createDataFrame([(label, distance, zone, inside)], schema)).first()
    assert (row["anomaly_score"], row["is_anomaly"], row["risk_level"]) == (score, anomaly, risk)


def test_heat_point_sampling_keeps_anomalies(spark):
    rows = [(i, 1, 1.0, 1.0, 0.5, i == 5, DAY + dt.timedelta(seconds=i), None) for i in range(12)]
    table = spark.createDataFrame(rows, TABLES["anomalies"])
    got = anomalies.heat_points(table, "2024-01-06T00:00:00+00:00", hours=48, sampling=4)
    assert sorted(values(got, "id")) == [0, 4, 5, 8]
    first = anomalies.heat_points(table, "2024-01-06T00:00:00+00:00", hours=48, limit=3)
    assert sorted(values(first, "id")) == [0, 1, 2]


def test_risk_filter_survives_missing_metadata(spark):
    rows = [(1, 1, 1.0, 1.0, 0.9, True, DAY, '{"risk_level":"high"}'), (2, 1, 1.0, 1.0, 0.9, True, DAY, None)]
    got = anomalies.anomaly_report(spark.createDataFrame(rows, TABLES["anomalies"]), "2024-01-06T00:00:00+00:00",
                                   risk="high")
    assert values(got, "id") == [1]


def test_risk_filter_has_no_limit_and_reports_are_newest_first(spark):
    rows = spark.range(6000).selectExpr(
        "id", "1L AS device_id", "1.0D AS latitude", "1.0D AS longitude", "0.9D AS anomaly_score", "true AS is_anomaly",
        "timestamp'2024-01-05 00:00:00' + make_interval(0,0,0,0,0,0,id) AS detected_at", "'{\"risk_level\":\"high\"}' AS metadata",
    )
    now = "2024-01-06T00:00:00+00:00"
    assert anomalies.anomaly_report(rows, now, risk="high").count() == 6000
    assert values(anomalies.anomaly_report(rows, now, limit=3), "id") == [5999, 5998, 5997]


def test_zone_heatmap_of_zero_densities(spark):
    rows = [(1, 0, 1.0, 1.0, 0.0, 5.0, 3, None, DAY, DAY), (1, 1, 1.0, 1.0, None, 5.0, 3, "main", DAY, DAY)]
    got = zones.zone_heatmap(spark.createDataFrame(rows, TABLES["zones"])).orderBy("cluster_id").collect()
    assert [(r["weight"], r["label"]) for r in got] == [(0.0, "secondary"), (0.0, "main")]


def test_changes(spark):
    devices = spark.createDataFrame([(1, 0), (2, 3)], "id bigint, modo int")
    feed = spark.createDataFrame(
        [(1, 1, 2, DAY), (2, 1, 1, DAY), (3, 1, 9, DAY + dt.timedelta(1)), (4, 7, 1, DAY), (5, 2, None, DAY)],
        "id bigint, device_id bigint, modo int, changed_at timestamp",
    )
    valid = tracking._valid_mode()
    got = apply_changes(devices, feed, "device_id", "modo", valid)
    assert {r["id"]: (r["modo"], r["updated"]) for r in got.collect()} == {1: (1, True), 2: (3, False)}
    bad = rejected_changes(devices, feed, "device_id", valid)
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        3: "invalid_value", 4: "unknown_key", 5: "invalid_value"
    }


def test_time_filters_reach_the_scan(spark, tmp_path):
    positions(spark, [(1, 1, 0, -17.0, -63.0, 1.0)]).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    plan = scans.recent_positions(table, AS_OF).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(recorded_at" in plan
    assert "isnotnull(latitude" in plan
    assert "ReadSchema: struct<id:bigint,recorded_at:timestamp,latitude:double,longitude:double>" in plan


def test_day_partitions_are_pruned(spark, tmp_path):
    table = positions(spark, [(1, 1, 0, -17.0, -63.0, 1.0)]).withColumn("date", F.to_date("recorded_at"))
    table.write.partitionBy("date").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = scans.last_days(stored, AS_OF, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_jdbc_options():
    got = jdbc.options("positions", "jdbc:postgresql://db/fleet", "2024-01-01", "2024-02-01", 64, "recorded_at")
    assert got["numPartitions"] == "64"
    assert "ST_Y(geom::geometry) AS latitude" in got["dbtable"]
