"""Reports on devices, positions, alerts and fences. Each answers for the whole fleet or, filtered, for one key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.operators.changes import apply_changes, rejected_changes
from waymark.operators.ranking import newest_rows, top_k
from waymark.sources import scans


def only(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """Rows with one value of a column, or all rows when no value is asked for."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


def vehicle_devices(devices: DataFrame) -> DataFrame:
    """The device that speaks for each vehicle: the one with the lowest id."""
    known = devices.where(F.col("vehicle_id").isNotNull())
    return known.groupBy("vehicle_id").agg(F.min("id").alias("device_id"))


def by_vehicle(report: DataFrame, devices: DataFrame, vehicle_id: int | None = None) -> DataFrame:
    """A device report keyed by vehicle."""
    return report.join(only(vehicle_devices(devices), "vehicle_id", vehicle_id), "device_id")


def unknown_vehicles(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """Requested vehicles that no device reports for."""
    return requests.select("vehicle_id").distinct().join(vehicle_devices(devices), "vehicle_id", "left_anti")


def device_list(devices: DataFrame, device_id: int | None = None) -> DataFrame:
    return only(devices, "id", device_id).select("id", "device_imei", "vehicle_id", "status", "modo", "last_seen")


def device_detail(devices: DataFrame, device_id: int | None = None, imei: str | None = None) -> DataFrame:
    return only(only(devices, "id", device_id), "device_imei", imei)


def latest_positions(positions: DataFrame) -> DataFrame:
    """Newest position of every device (highest id among equal times); one row per device and task is shuffled."""
    return newest_rows(positions, "device_id", join_back=True)


def latest_positions_report(positions: DataFrame, limit: int = S.POSITION_LIMIT) -> DataFrame:
    columns = ["id", "device_id", "latitude", "longitude", "speed", "heading", "recorded_at"]
    return latest_positions(positions.select(*columns)).select(*columns).orderBy("device_id").limit(limit)


def last_position(positions: DataFrame, device_id: int | None = None) -> DataFrame:
    columns = ["id", "device_id", "speed", "heading", "altitude", "satellites", "accuracy", "recorded_at"]
    return latest_positions(only(positions, "device_id", device_id).select(*columns)).select(*columns)


def history(
    positions: DataFrame, start: datetime | str, end: datetime | str, device_id: int | None = None
) -> DataFrame:
    columns = ["id", "device_id", "speed", "heading", "altitude", "satellites", "accuracy", "recorded_at"]
    return scans.history(only(positions, "device_id", device_id), start, end).select(*columns)


def ordered_history(rows: DataFrame) -> DataFrame:
    """Oldest first; Spark sorts by range, so no task holds everything."""
    return rows.orderBy("device_id", "recorded_at", "id")


def alerts(
    table: DataFrame, device_id: int | None = None, unresolved: bool = False, limit: int = S.ALERT_LIMIT
) -> DataFrame:
    """Newest `limit` alerts per device, or all unresolved ones, newest first."""
    columns = ["id", "device_id", "alert_type", "severity", "resolved", "created_at", "metadata"]
    rows = only(table, "device_id", device_id).select(*columns)
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    found = rows.where(~F.col("resolved")) if unresolved else top_k(rows, ["device_id"], order, limit, ["id"]).drop("rank")
    return found.orderBy("device_id", *order)


def vehicle_geofences(fences: DataFrame, vehicle_id: int | None = None) -> DataFrame:
    return only(fences, "vehicle_id", vehicle_id).select("id", "vehicle_id", "name", "type", "active", "created_at")


def _valid_mode() -> Column:
    # 0 normal, 1 tracking, 2 block, 3 safe geofence
    return F.col("modo").isin(0, 1, 2, 3)


def change_modes(devices: DataFrame, feed: DataFrame) -> DataFrame:
    return apply_changes(devices, feed, "device_id", "modo", _valid_mode())


def rejected_modes(devices: DataFrame, feed: DataFrame) -> DataFrame:
    return rejected_changes(devices, feed, "device_id", _valid_mode())


def resolve_alerts(table: DataFrame, feed: DataFrame) -> DataFrame:
    return apply_changes(table, feed, "alert_id", "resolved", F.col("resolved"))


def rejected_resolutions(table: DataFrame, feed: DataFrame) -> DataFrame:
    return rejected_changes(table, feed, "alert_id", F.col("resolved"))
