"""Cleaning and daily routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import settings as S
from waymark.operators import cleaning
from waymark.operators.ranking import with_previous
from waymark.plans import routes
from waymark.sources.fixtures import AS_OF, load, oracle, portable_sql
from waymark.sources.scans import on_days, recent_positions

HAVERSINE = (
    "2 * CAST(6371000 AS DOUBLE) * asin(sqrt(CASE WHEN {a} > 1 THEN CAST(1 AS DOUBLE) ELSE {a} END))"
)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return HAVERSINE.format(a=a)


def clean_ctes(source: str) -> str:
    """Check SQL for cleaning: ends in the CTE `clean`."""
    return f"""
deduped AS (
  SELECT *, CAST(recorded_at AS DATE) AS date FROM {source}
  QUALIFY row_number() OVER (PARTITION BY device_id, CAST(recorded_at AS DATE), recorded_at ORDER BY id) = 1),
clipped AS (
  SELECT * REPLACE (CASE WHEN speed < 0 THEN 0 WHEN speed > 250 THEN 250 ELSE speed END AS speed)
  FROM deduped WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
filled AS (
  SELECT id, device_id, date, recorded_at, latitude, longitude, satellites,
    coalesce(speed, median(speed) OVER d) AS speed,
    coalesce(heading, median(heading) OVER d) AS heading,
    coalesce(altitude, median(altitude) OVER d) AS altitude,
    coalesce(accuracy, median(accuracy) OVER d) AS accuracy,
    hour(recorded_at) AS hour
  FROM clipped WINDOW d AS (PARTITION BY device_id, date)),
stepped AS (
  SELECT *, lag(latitude) OVER t AS plat, lag(longitude) OVER t AS plon
  FROM filled WINDOW t AS (PARTITION BY device_id, date ORDER BY recorded_at)),
clean AS (
  SELECT * EXCLUDE (plat, plon),
    CASE WHEN plat IS NULL THEN 0 ELSE {haversine_sql('plat', 'plon', 'latitude', 'longitude')} END AS dist_from_prev
  FROM stepped
  WHERE plat IS NULL OR {haversine_sql('plat', 'plon', 'latitude', 'longitude')} < 5000)"""


SUMMARY = """
  SELECT device_id, date, count(*) AS point_count, round(sum(dist_from_prev), 3) AS total_distance,
    coalesce(round(avg(speed), 3), 0) AS avg_speed
  FROM clean GROUP BY device_id, date HAVING count(*) >= 5"""


def _deduplicated(spark, sf):
    rows = cleaning.deduplicate(load(spark, sf, "positions_dup"))
    return rows.select("id", "device_id", "recorded_at", "speed")


def _median_fill(spark, sf):
    rows = cleaning.with_coordinates(cleaning.deduplicate(load(spark, sf, "positions")))
    rows = rows.withColumn("hour", F.hour("recorded_at"))
    filled = cleaning.fill_gaps(rows, cleaning.day_medians(rows))
    return filled.select("id", *[F.round(c, 6).alias(c) for c in cleaning.SENSORS])


def _clean(spark, sf):
    rows = cleaning.clean_positions(load(spark, sf, "positions_dup"))
    return rows.select(
        "id",
        "device_id",
        "date",
        "hour",
        *[F.round(c, 6).alias(c) for c in ("latitude", "longitude", *cleaning.SENSORS)],
        F.round("dist_from_prev", 3).alias("dist_from_prev"),
    )


def _step_distance(spark, sf):
    rows = recent_positions(load(spark, sf, "positions"), AS_OF, hours=24 * 30).withColumn(
        "slot", F.date_trunc("hour", "recorded_at")
    )
    stepped = cleaning.with_step_distance(rows, ["device_id"], "slot", ["recorded_at", "id"])
    return stepped.select("id", F.round("dist_from_prev", 3).alias("dist_from_prev"))


def daily_routes(spark, sf):
    return routes.daily_routes(load(spark, sf, "positions"))


def _routes_last_days(spark, sf):
    return routes.routes_of_last_days(load(spark, sf, "positions"), AS_OF, S.TRAINING_DAYS)


def _points(spark, sf):
    return routes.route_points(load(spark, sf, "positions"))


def _segments(spark, sf):
    return routes.route_segments(_points(spark, sf)).select(
        "device_id",
        "date",
        "slot",
        "segment",
        F.size("points").alias("points"),
        F.round(F.get("points", F.lit(0))["latitude"], 6).alias("first_latitude"),
        F.element_at("points", -1)["recorded_at"].alias("last_recorded_at"),
        F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p.speed), 3).alias("speed_sum"),
    )


def _route_round_trip(spark, sf):
    stored = routes.routes_as_json(routes.route_segments(_points(spark, sf)))
    points = routes.routes_from_json(stored)
    return points.groupBy("device_id", "date", "hour").agg(
        F.count(F.lit(1)).alias("points"),
        F.round(F.sum("latitude"), 6).alias("latitude_sum"),
        F.max("recorded_at").alias("last_recorded_at"),
    )


def _skipped_days(spark, sf):
    return routes.skipped_days(_points(spark, sf))


def _route_of_day(spark, sf):
    positions = load(spark, sf, "positions")
    stored = routes.daily_routes(on_days(positions, "2024-01-01", "2024-01-29"))
    return routes.route_of_day(positions, stored, "2024-01-30T12:00:00+00:00", "2024-01-30")


def _previous_time(spark, sf):
    rows = load(spark, sf, "positions").withColumn("slot", F.date_trunc("hour", "recorded_at"))
    return with_previous(rows, ["device_id"], "slot", ["recorded_at", "id"], ["id"]).select("id", "prev_id")


QUERIES = {
    "position_dedupe": _deduplicated,
    "median_fill": _median_fill,
    "clean_positions": _clean,
    "step_distance": _step_distance,
    "previous_position": _previous_time,
    "daily_routes": daily_routes,
    "daily_routes_last_days": _routes_last_days,
    "route_segments": _segments,
    "route_json_round_trip": _route_round_trip,
    "route_skipped_days": _skipped_days,
    "route_of_open_day": _route_of_day,
}

CHECKS = {
    "position_dedupe": oracle(
        "SELECT id, device_id, recorded_at, speed FROM positions_dup "
        "QUALIFY row_number() OVER (PARTITION BY device_id, recorded_at ORDER BY id) = 1",
        "positions_dup",
    ),
    "median_fill": oracle(
        """SELECT id, round(coalesce(speed, median(speed) OVER d), 6) AS speed,
          round(coalesce(heading, median(heading) OVER d), 6) AS heading,
          round(coalesce(altitude, median(altitude) OVER d), 6) AS altitude,
          round(coalesce(accuracy, median(accuracy) OVER d), 6) AS accuracy
        FROM positions WHERE latitude IS NOT NULL
        WINDOW d AS (PARTITION BY device_id, CAST(recorded_at AS DATE))""",
        "positions",
    ),
    "clean_positions": oracle(
        f"""WITH {clean_ctes('positions_dup')}
        SELECT id, device_id, date, hour, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
          round(speed, 6) AS speed, round(heading, 6) AS heading, round(altitude, 6) AS altitude,
          round(accuracy, 6) AS accuracy, round(dist_from_prev, 3) AS dist_from_prev
        FROM clean""",
        "positions_dup",
    ),
    "step_distance": oracle(
        f"""SELECT id, round(coalesce({haversine_sql('plat', 'plon', 'latitude', 'longitude')}, 0), 3) AS dist_from_prev
        FROM (SELECT *, lag(latitude) OVER t AS plat, lag(longitude) OVER t AS plon FROM positions
              WHERE recorded_at >= TIMESTAMP '2024-01-01 00:00:00' AND latitude IS NOT NULL
              WINDOW t AS (PARTITION BY device_id ORDER BY recorded_at, id))""",
        "positions",
    ),
    "previous_position": oracle(
        "SELECT id, lag(id) OVER (PARTITION BY device_id ORDER BY recorded_at, id) AS prev_id FROM positions",
        "positions",
    ),
    "daily_routes": oracle(f"WITH {clean_ctes('positions')} {SUMMARY}", "positions"),
    "daily_routes_last_days": oracle(
        f"""WITH {clean_ctes("(SELECT * FROM positions WHERE recorded_at >= TIMESTAMP '2024-01-11 00:00:00'"
                             " AND recorded_at < TIMESTAMP '2024-01-31 00:00:00')")} {SUMMARY}""",
        "positions",
    ),
    "route_segments": oracle(
        f"""WITH {clean_ctes('positions')},
        kept AS (SELECT *, count(*) OVER (PARTITION BY device_id, date) AS n FROM clean),
        numbered AS (SELECT *, (row_number() OVER (PARTITION BY device_id, date, hour ORDER BY recorded_at) - 1) // 1000
          AS segment FROM kept WHERE n >= 5)
        SELECT device_id, date, hour AS slot, segment, count(*) AS points,
          round(arg_min(latitude, recorded_at), 6) AS first_latitude, max(recorded_at) AS last_recorded_at,
          round(sum(speed), 3) AS speed_sum
        FROM numbered GROUP BY device_id, date, hour, segment""",
        "positions",
    ),
    "route_json_round_trip": oracle(
        f"""WITH {clean_ctes('positions')},
        kept AS (SELECT *, count(*) OVER (PARTITION BY device_id, date) AS n FROM clean)
        SELECT device_id, date, hour, count(*) AS points, round(sum(latitude), 6) AS latitude_sum,
          max(recorded_at) AS last_recorded_at
        FROM kept WHERE n >= 5 GROUP BY device_id, date, hour""",
        "positions",
    ),
    "route_skipped_days": oracle(
        f"""WITH {clean_ctes('positions')}
        SELECT device_id, date, count(*) AS point_count, 'too_few_points' AS reason
        FROM clean GROUP BY device_id, date HAVING count(*) < 5""",
        "positions",
    ),
    "route_of_open_day": oracle(
        f"WITH {clean_ctes('positions')} SELECT * FROM ({SUMMARY}) WHERE date = DATE '2024-01-30'", "positions"
    ),
}

_TIMES = {
    "position_dedupe": ["recorded_at"],
    "clean_positions": ["date"],
    "daily_routes": ["date"],
    "daily_routes_last_days": ["date"],
    "route_segments": ["date", "last_recorded_at"],
    "route_json_round_trip": ["date", "last_recorded_at"],
    "route_skipped_days": ["date"],
    "route_of_open_day": ["date"],
}
CHECKS = {name: portable_sql(text, *_TIMES[name]) if name in _TIMES else text for name, text in CHECKS.items()}
