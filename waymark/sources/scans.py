"""Time-bounded scans. Bounds are plain comparisons on the stored column, so they reach the Parquet scan
and, where the table is partitioned by `date`, prune partitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.scalars import as_timestamp, since


def _bounded(df: DataFrame, column: str, low: Column, high: Column | None = None) -> DataFrame:
    rows = df.where(F.col(column) >= low)
    if high is not None:
        rows = rows.where(F.col(column) < high)
    if "date" in df.columns:
        rows = rows.where(F.col("date") >= F.to_date(low))
        if high is not None:
            rows = rows.where(F.col("date") <= F.to_date(high))
    return rows


def located(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def on_days(positions: DataFrame, first: str, last: str) -> DataFrame:
    """Located positions of the UTC days `first` to `last`, both included."""
    low = F.lit(first).cast("date").cast("timestamp")
    high = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")
    return located(_bounded(positions, "recorded_at", low, high))


def last_days(positions: DataFrame, as_of: datetime | str, days: int) -> DataFrame:
    """Located positions of the `days` full days before the day of `as_of`."""
    today = F.to_date(as_timestamp(as_of))
    low = F.date_sub(today, days).cast("timestamp")
    return located(_bounded(positions, "recorded_at", low, today.cast("timestamp")))


def recent(df: DataFrame, column: str, as_of: datetime | str, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows not older than the lookback."""
    return _bounded(df, column, since(as_of, days=days, hours=hours))


def recent_positions(positions: DataFrame, as_of: datetime | str, hours: int = S.SCORING_HOURS) -> DataFrame:
    return located(recent(positions, "recorded_at", as_of, hours=hours))


def sensor_positions(positions: DataFrame, as_of: datetime | str, days: int = S.SENSOR_DAYS) -> DataFrame:
    """Rows for the sensor model; a missing location is allowed here."""
    return recent(positions, "recorded_at", as_of, days=days)


def history(positions: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Closed time range, oldest first."""
    rows = positions.where(F.col("recorded_at").between(as_timestamp(start), as_timestamp(end)))
    if "date" in positions.columns:
        days = (F.to_date(as_timestamp(start)), F.to_date(as_timestamp(end)))
        rows = rows.where(F.col("date").between(*days))
    return rows


def telemetry_sample(
    positions: DataFrame, as_of: datetime | str, days: int = S.HEATMAP_DAYS, every: int = S.TELEMETRY_EVERY
) -> DataFrame:
    """Fleet positions for the heatmap: plausible speed, one id in `every`. An unknown speed drops out."""
    rows = located(recent(positions, "recorded_at", as_of, days=days))
    return rows.where((F.abs("speed") < S.TELEMETRY_SPEED_KMH) & (F.col("id") % every == 0))


def stored_routes(segments: DataFrame, as_of: datetime | str, days: int = S.TRAINING_DAYS) -> DataFrame:
    """Route segments dated within `days` of `as_of`'s day."""
    return segments.where(F.col("date") >= F.date_sub(F.to_date(as_timestamp(as_of)), days))


def active_devices(df: DataFrame, devices: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Rows of active devices, or of all known devices."""
    known = devices if include_inactive else devices.where(F.col("status") == "active")
    return df.join(known.select(F.col("id").alias("device_id")), "device_id", "left_semi")
