"""Scored points, summaries, weekly report and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.plans import anomalies as A
from waymark.plans import routes as R
from waymark.plans import tracking as T
from waymark.catalog.routes import SUMMARY, clean_ctes
from waymark.sources.fixtures import AS_OF, load, oracle, portable_sql


def _report(**options):
    return lambda spark, sf: A.anomaly_report(load(spark, sf, "anomalies"), AS_OF, **options)


def _counts(spark, sf):
    return A.report_counts(A.anomaly_report(load(spark, sf, "anomalies"), AS_OF))


def _heat_counts(spark, sf):
    points = A.heat_points(load(spark, sf, "anomalies"), AS_OF, hours=720, min_score=0.25, sampling=10)
    return A.report_counts(points, F.col("kind") == "anomalous")


def _vehicle_report(spark, sf):
    report = A.anomaly_report(load(spark, sf, "anomalies"), AS_OF, only_anomalies=True)
    return T.by_vehicle(report, load(spark, sf, "devices")).select("vehicle_id", "device_id", "id", "risk_level")


def _heat(**options):
    return lambda spark, sf: A.heat_points(load(spark, sf, "anomalies"), AS_OF, **options)


def _summary(spark, sf):
    return A.device_summary(load(spark, sf, "anomalies"), load(spark, sf, "models"), AS_OF)


def _latest_models(spark, sf):
    return A.latest_models(load(spark, sf, "models"))


def _anomaly(plan):
    return lambda spark, sf: plan(load(spark, sf, "anomalies"), AS_OF)


def _recent_routes(spark, sf):
    return A.recent_routes(R.daily_routes(load(spark, sf, "positions")))


QUERIES = {
    "anomaly_report": _report(),
    "anomaly_report_only_anomalies": _report(only_anomalies=True),
    "anomaly_report_high_risk": _report(risk="high"),
    "anomaly_report_counts": _counts,
    "heat_point_counts": _heat_counts,
    "vehicle_anomalies": _vehicle_report,
    "device_anomalies": lambda spark, sf: A.device_anomalies(load(spark, sf, "anomalies")),
    "device_heat_points": _heat(),
    "device_heat_points_sampled": _heat(hours=720, min_score=0.25, sampling=10),
    "device_summary": _summary,
    "latest_models": _latest_models,
    "weekly_totals": _anomaly(A.weekly_totals),
    "weekly_hours": _anomaly(A.weekly_hours),
    "weekly_peak_hours": _anomaly(A.peak_hours),
    "weekly_trend": _anomaly(A.weekly_trend),
    "scoring_summary": lambda spark, sf: A.scoring_summary(load(spark, sf, "anomalies")),
    "recent_routes": _recent_routes,
}

_ROWS = """rows_ AS (SELECT id, device_id, latitude, longitude, anomaly_score, is_anomaly,
  json_extract_string(metadata, '$.risk_level') AS risk_level, detected_at
  FROM anomalies WHERE detected_at >= TIMESTAMP '2024-01-24 00:00:00')"""
_NEWEST = "row_number() OVER (PARTITION BY device_id ORDER BY detected_at DESC, id DESC)"
_WEEK = "detected_at >= TIMESTAMP '2024-01-24 00:00:00'"


def _heat_sql(since: str, score: str, every: int) -> str:
    return oracle(
        f"""SELECT id, device_id, latitude AS lat, longitude AS lng, anomaly_score AS weight,
          CASE WHEN is_anomaly THEN 'anomalous' ELSE 'normal' END AS kind
        FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY detected_at, id) - 1 AS i FROM anomalies
              WHERE detected_at >= TIMESTAMP '{since}' AND latitude IS NOT NULL AND longitude IS NOT NULL
                AND anomaly_score >= CAST({score} AS DOUBLE))
        WHERE i < 5000 AND (is_anomaly OR i % {every} = 0)""",
        "anomalies",
    )


CHECKS = {
    "anomaly_report": portable_sql(
        oracle(f"WITH {_ROWS} SELECT * FROM rows_ QUALIFY {_NEWEST} <= 500", "anomalies"), "detected_at"
    ),
    "anomaly_report_only_anomalies": portable_sql(
        oracle(f"WITH {_ROWS} SELECT * FROM rows_ WHERE is_anomaly QUALIFY {_NEWEST} <= 500", "anomalies"),
        "detected_at",
    ),
    "anomaly_report_high_risk": portable_sql(
        oracle(f"WITH {_ROWS} SELECT * FROM rows_ WHERE risk_level = 'high'", "anomalies"),
        "detected_at",
    ),
    "anomaly_report_counts": oracle(
        f"""WITH {_ROWS} SELECT device_id, count(*) AS count, count(*) FILTER (is_anomaly) AS anomaly_count
        FROM (SELECT * FROM rows_ QUALIFY {_NEWEST} <= 500) GROUP BY device_id""",
        "anomalies",
    ),
    "vehicle_anomalies": oracle(
        f"""WITH {_ROWS} SELECT d.vehicle_id, r.device_id, r.id, r.risk_level
        FROM (SELECT * FROM rows_ WHERE is_anomaly QUALIFY {_NEWEST} <= 500) r
        JOIN (SELECT vehicle_id, min(id) AS device_id FROM devices GROUP BY vehicle_id) d USING (device_id)""",
        "anomalies",
        "devices",
    ),
    "device_anomalies": portable_sql(
        oracle(f"SELECT * FROM anomalies QUALIFY {_NEWEST} <= 100", "anomalies"), "detected_at"
    ),
    "device_heat_points": _heat_sql("2024-01-30 00:00:00", "0", 1),
    "device_heat_points_sampled": _heat_sql("2024-01-01 00:00:00", "0.25", 10),
    "device_summary": portable_sql(
        oracle(
            f"""WITH totals AS (
              SELECT device_id, count(*) AS total_points, count(*) FILTER (is_anomaly) AS anomaly_count,
                count(*) FILTER (coalesce(json_extract_string(metadata, '$.risk_level'), 'low') = 'low') AS risk_low,
                count(*) FILTER (json_extract_string(metadata, '$.risk_level') = 'medium') AS risk_medium,
                count(*) FILTER (json_extract_string(metadata, '$.risk_level') = 'high') AS risk_high
              FROM anomalies WHERE {_WEEK} GROUP BY device_id),
            newest AS (SELECT * FROM models
              QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, id DESC) = 1)
            SELECT t.*, round(CAST(anomaly_count AS DOUBLE) / total_points, 4) AS anomaly_rate, n.id AS model_id,
              n.model_type, n.trained_from, n.trained_to, n.created_at AS trained_at
            FROM totals t LEFT JOIN newest n USING (device_id)""",
            "anomalies",
            "models",
        ),
        "trained_from",
        "trained_to",
        "trained_at",
    ),
    "latest_models": portable_sql(
        oracle(
            "SELECT * FROM models "
            "QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, id DESC) = 1",
            "models",
        ),
        "trained_from",
        "trained_to",
        "created_at",
    ),
    "weekly_totals": oracle(
        f"""SELECT device_id, count(*) AS total_points, count(*) FILTER (is_anomaly) AS anomaly_count,
          concat(CAST(round(CAST(count(*) FILTER (is_anomaly) * 100 AS DOUBLE) / count(*), 2) AS VARCHAR), '%')
            AS anomaly_rate
        FROM anomalies WHERE {_WEEK} GROUP BY device_id""",
        "anomalies",
    ),
    "weekly_hours": oracle(
        f"""SELECT device_id, hour(detected_at) AS hour, count(*) AS count FROM anomalies
        WHERE {_WEEK} AND is_anomaly GROUP BY ALL""",
        "anomalies",
    ),
    "weekly_peak_hours": oracle(
        f"""SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY count DESC, hour) AS rank FROM (
          SELECT device_id, hour(detected_at) AS hour, count(*) AS count FROM anomalies
          WHERE {_WEEK} AND is_anomaly GROUP BY ALL) QUALIFY rank <= 5""",
        "anomalies",
    ),
    "weekly_trend": portable_sql(
        oracle(
            f"""SELECT device_id, CAST(detected_at AS DATE) AS date, count(*) AS total_points,
              count(*) FILTER (is_anomaly) AS anomaly_points,
              round(CAST(count(*) FILTER (is_anomaly) * 100 AS DOUBLE) / count(*), 2) AS percentage
            FROM anomalies WHERE {_WEEK} GROUP BY ALL""",
            "anomalies",
        ),
        "date",
    ),
    "scoring_summary": oracle(
        "SELECT device_id, count(*) AS points_scored, count(*) FILTER (is_anomaly) AS anomalies "
        "FROM anomalies GROUP BY device_id",
        "anomalies",
    ),
    "recent_routes": portable_sql(
        oracle(
            f"""WITH {clean_ctes('positions')}
            SELECT device_id, date, point_count, total_distance, avg_speed FROM ({SUMMARY})
            QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY date DESC) <= 30""",
            "positions",
        ),
        "date",
    ),
}

CHECKS["heat_point_counts"] = f"""SELECT device_id, count(*) AS count, count(*) FILTER (kind = 'anomalous') AS anomaly_count
  FROM ({CHECKS["device_heat_points_sampled"]}) GROUP BY device_id"""
