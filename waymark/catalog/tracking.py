"""Devices, positions, alerts, fences and their change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.plans import tracking as T
from waymark.plans.anomalies import report_counts
from waymark.sources.fixtures import load, oracle, portable_sql

START, END = "2024-01-05T00:00:00+00:00", "2024-01-20T00:00:00+00:00"


def _by_vehicle(spark, sf):
    devices = load(spark, sf, "devices")
    latest = T.latest_positions(load(spark, sf, "positions").select("id", "device_id", "recorded_at"))
    return T.by_vehicle(latest, devices).select("vehicle_id", "device_id", "id")


def _unknown_vehicles(spark, sf):
    fleet = load(spark, sf, "devices").where("status = 'active'")
    return T.unknown_vehicles(load(spark, sf, "devices"), fleet)


def _unresolved_totals(spark, sf):
    rows = T.alerts(load(spark, sf, "alerts"), unresolved=True)
    return rows.groupBy("device_id").agg(F.count(F.lit(1)).alias("count"))


def _history_counts(spark, sf):
    return report_counts(T.history(load(spark, sf, "positions"), START, END))


def _latest_count(spark, sf):
    return T.latest_positions_report(load(spark, sf, "positions")).agg(F.count(F.lit(1)).alias("count"))


def _device_count(spark, sf):
    return T.device_list(load(spark, sf, "devices")).agg(F.count(F.lit(1)).alias("count"))


#: What keyed reports ask for.
DEVICE, IMEI, VEHICLE = 4, "imei-6", 1003

QUERIES = {
    "device_by_id": lambda spark, sf: T.device_list(load(spark, sf, "devices"), DEVICE),
    "device_by_imei": lambda spark, sf: T.device_detail(load(spark, sf, "devices"), imei=IMEI).select("id", "device_imei", "modo"),
    "geofences_of_vehicle": lambda spark, sf: T.vehicle_geofences(load(spark, sf, "geofences"), VEHICLE).drop("created_at"),
    "last_position_of_device": lambda spark, sf: T.last_position(load(spark, sf, "positions"), DEVICE),
    "history_of_device": lambda spark, sf: T.ordered_history(T.history(load(spark, sf, "positions"), START, END, DEVICE)),
    "alerts_of_device": lambda spark, sf: T.alerts(load(spark, sf, "alerts"), DEVICE).drop("created_at"),
    "device_list_count": _device_count,
    "position_history_counts": _history_counts,
    "latest_positions_count": _latest_count,
    "vehicle_device": lambda spark, sf: T.vehicle_devices(load(spark, sf, "devices")),
    "vehicle_last_position": _by_vehicle,
    "unknown_vehicles": _unknown_vehicles,
    "device_list": lambda spark, sf: T.device_list(load(spark, sf, "devices")),
    "device_detail": lambda spark, sf: T.device_detail(load(spark, sf, "devices")),
    "latest_positions": lambda spark, sf: T.latest_positions(load(spark, sf, "positions")),
    "latest_positions_report": lambda spark, sf: T.latest_positions_report(load(spark, sf, "positions")),
    "last_position": lambda spark, sf: T.last_position(load(spark, sf, "positions")),
    "position_history": lambda spark, sf: T.history(load(spark, sf, "positions"), START, END),
    "device_history": lambda spark, sf: T.ordered_history(T.history(load(spark, sf, "positions"), START, END)),
    "device_alerts": lambda spark, sf: T.alerts(load(spark, sf, "alerts")),
    "unresolved_alerts": lambda spark, sf: T.alerts(load(spark, sf, "alerts"), unresolved=True),
    "unresolved_alert_counts": _unresolved_totals,
    "vehicle_geofences": lambda spark, sf: T.vehicle_geofences(load(spark, sf, "geofences")),
    "mode_changes": lambda spark, sf: T.change_modes(load(spark, sf, "devices"), load(spark, sf, "modes")).select(
        "id", "modo", "updated"
    ),
    "mode_rejects": lambda spark, sf: T.rejected_modes(load(spark, sf, "devices"), load(spark, sf, "modes")),
    "alert_resolutions": lambda spark, sf: T.resolve_alerts(
        load(spark, sf, "alerts"), load(spark, sf, "resolutions")
    ).select("id", "resolved", "updated"),
    "alert_resolution_rejects": lambda spark, sf: T.rejected_resolutions(
        load(spark, sf, "alerts"), load(spark, sf, "resolutions")
    ),
}

_LATEST = "row_number() OVER (PARTITION BY device_id ORDER BY recorded_at DESC, id DESC) = 1"
_SENSORS = "id, device_id, speed, heading, altitude, satellites, accuracy, recorded_at"
_HISTORY = "recorded_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"
_ALERTS = "SELECT id, device_id, alert_type, severity, resolved, created_at, metadata FROM alerts"

CHECKS = {
    "device_by_id": oracle(
        f"""SELECT id, device_imei, vehicle_id, status, modo, strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen
        FROM devices WHERE id = {DEVICE}""",
        "devices",
    ),
    "device_by_imei": oracle(f"SELECT id, device_imei, modo FROM devices WHERE device_imei = '{IMEI}'", "devices"),
    "geofences_of_vehicle": oracle(f"SELECT id, vehicle_id, name, type, active FROM geofences WHERE vehicle_id = {VEHICLE}", "geofences"),
    "last_position_of_device": portable_sql(
        oracle(f"SELECT {_SENSORS} FROM positions WHERE device_id = {DEVICE} QUALIFY {_LATEST}", "positions"), "recorded_at"
    ),
    "history_of_device": portable_sql(
        oracle(f"SELECT {_SENSORS} FROM positions WHERE device_id = {DEVICE} AND {_HISTORY}", "positions"), "recorded_at"
    ),
    "alerts_of_device": oracle(
        f"""SELECT id, device_id, alert_type, severity, resolved, metadata FROM alerts WHERE device_id = {DEVICE}
        QUALIFY row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) <= 50""",
        "alerts",
    ),
    "device_list_count": oracle("SELECT count(*) AS count FROM devices", "devices"),
    "position_history_counts": oracle(
        f"SELECT device_id, count(*) AS count FROM positions WHERE {_HISTORY} GROUP BY device_id", "positions"
    ),
    "latest_positions_count": oracle("SELECT least(count(DISTINCT device_id), 100) AS count FROM positions", "positions"),
    "vehicle_device": oracle("SELECT vehicle_id, min(id) AS device_id FROM devices GROUP BY vehicle_id", "devices"),
    "vehicle_last_position": oracle(
        f"""SELECT d.vehicle_id, p.device_id, p.id FROM (SELECT * FROM positions QUALIFY {_LATEST}) p
        JOIN (SELECT vehicle_id, min(id) AS device_id FROM devices GROUP BY vehicle_id) d USING (device_id)""",
        "devices",
        "positions",
    ),
    "unknown_vehicles": oracle("SELECT vehicle_id FROM devices WHERE status <> 'active'", "devices"),
    "device_list": oracle(
        "SELECT id, device_imei, vehicle_id, status, modo, strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen "
        "FROM devices",
        "devices",
    ),
    "device_detail": oracle(
        "SELECT * REPLACE (strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, "
        "strftime(activated_at, '%Y-%m-%d %H:%M:%S.%f') AS activated_at) FROM devices",
        "devices",
    ),
    "latest_positions": portable_sql(oracle(f"SELECT * FROM positions QUALIFY {_LATEST}", "positions"), "recorded_at"),
    "latest_positions_report": portable_sql(
        oracle(
            f"""SELECT id, device_id, latitude, longitude, speed, heading, recorded_at FROM positions
            QUALIFY {_LATEST} ORDER BY device_id LIMIT 100""",
            "positions",
        ),
        "recorded_at",
    ),
    "last_position": portable_sql(
        oracle(f"SELECT {_SENSORS} FROM positions QUALIFY {_LATEST}", "positions"), "recorded_at"
    ),
    "position_history": portable_sql(
        oracle(f"SELECT {_SENSORS} FROM positions WHERE {_HISTORY}", "positions"), "recorded_at"
    ),
    "device_history": portable_sql(
        oracle(f"SELECT {_SENSORS} FROM positions WHERE {_HISTORY}", "positions"), "recorded_at"
    ),
    "device_alerts": portable_sql(
        oracle(
            f"{_ALERTS} QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, id DESC) <= 50",
            "alerts",
        ),
        "created_at",
    ),
    "unresolved_alerts": portable_sql(oracle(f"{_ALERTS} WHERE NOT resolved", "alerts"), "created_at"),
    "unresolved_alert_counts": oracle(
        "SELECT device_id, count(*) AS count FROM alerts WHERE NOT resolved GROUP BY device_id", "alerts"
    ),
    "vehicle_geofences": portable_sql(
        oracle("SELECT id, vehicle_id, name, type, active, created_at FROM geofences", "geofences"), "created_at"
    ),
    "mode_changes": oracle(
        """SELECT d.id, coalesce(n.modo, d.modo) AS modo, n.device_id IS NOT NULL AS updated
        FROM devices d LEFT JOIN (
          SELECT device_id, modo FROM modes WHERE modo BETWEEN 0 AND 3
          QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY changed_at DESC, id DESC) = 1) n
        ON n.device_id = d.id""",
        "devices",
        "modes",
    ),
    "mode_rejects": portable_sql(
        oracle(
            """SELECT *, CASE WHEN modo BETWEEN 0 AND 3 THEN 'unknown_key' ELSE 'invalid_value' END AS reason
            FROM modes WHERE modo NOT BETWEEN 0 AND 3 OR device_id NOT IN (SELECT id FROM devices)""",
            "devices",
            "modes",
        ),
        "changed_at",
    ),
    "alert_resolutions": oracle(
        """SELECT a.id, a.resolved OR a.id IN (SELECT alert_id FROM resolutions) AS resolved,
          a.id IN (SELECT alert_id FROM resolutions) AS updated FROM alerts a""",
        "alerts",
        "resolutions",
    ),
    "alert_resolution_rejects": portable_sql(
        oracle(
            "SELECT *, 'unknown_key' AS reason FROM resolutions WHERE alert_id NOT IN (SELECT id FROM alerts)",
            "alerts",
            "resolutions",
        ),
        "changed_at",
    ),
}
