"""Partitioned reads from a PostGIS database.

Untested here: no database is reachable from the build environment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Source tables and what is read from them; geometry becomes plain coordinates or GeoJSON
SOURCES = {
    "positions": (
        "SELECT id, device_id, recorded_at, ST_Y(geom::geometry) AS latitude, ST_X(geom::geometry) AS longitude, "
        "speed, heading, altitude, accuracy, satellites, metadata::text AS metadata FROM tracking.gps_positions"
    ),
    "devices": (
        "SELECT id, device_imei, vehicle_id, status, activated_at, last_seen, metadata::text AS metadata, modo "
        "FROM tracking.tracked_devices"
    ),
    "device_events": (
        "SELECT id, device_id, event_type, position_id, created_at, metadata::text AS metadata "
        "FROM tracking.device_events"
    ),
    "alerts": (
        "SELECT id, device_id, alert_type, severity, metadata::text AS metadata, created_at, resolved "
        "FROM tracking.alerts"
    ),
    "geofences": (
        "SELECT id, vehicle_id, name, ST_AsGeoJSON(geom) AS geojson, active, type, created_at, updated_at "
        "FROM tracking.geofences WHERE geom IS NOT NULL"
    ),
    "risk_zones": (
        "SELECT id, name, ST_AsGeoJSON(geom) AS geojson, risk_level, created_at "
        "FROM public.risk_zones WHERE geom IS NOT NULL"
    ),
}


def options(
    name: str, url: str, lower: str, upper: str, partitions: int, column: str = "id", fetch_rows: int = 10_000
) -> dict[str, str]:
    """Reader options; `partitions` connections each read one range of `column` (a time, say, or the id)."""
    return {
        "url": url,
        "driver": "org.postgresql.Driver",
        "dbtable": f"({SOURCES[name]}) AS {name}",
        "partitionColumn": column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_rows),
        "pushDownPredicate": "true",
    }


def read_jdbc(
    spark: SparkSession, name: str, url: str, credentials: dict[str, str], lower: str, upper: str, partitions: int,
    column: str = "id",
) -> DataFrame:
    read = options(name, url, lower, upper, partitions, column)
    return spark.read.format("jdbc").options(**read, **credentials).load()
