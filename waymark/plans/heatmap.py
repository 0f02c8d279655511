"""Fleet risk heatmap: weighted points of several sources on the hex grid."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions import hexgrid
from waymark.functions.scalars import json_number
from waymark.operators.spatial import hex_cells_of_shapes
from waymark.sources.scans import recent, telemetry_sample

# Weights by kind; anything else gets the warning weight, 'critical' alerts included
EVENT_WEIGHTS = {"bloqueo": S.WEIGHT_CRITICAL}
ALERT_WEIGHTS = {"high": S.WEIGHT_CRITICAL}

SOURCE_COLUMNS = ["lat", "lon", "type", "weight"]


def _weight(kind: Column, weights: Mapping[str, float]) -> Column:
    weight = F.lit(S.WEIGHT_WARNING)
    for name, value in weights.items():
        weight = F.when(kind == name, F.lit(value)).otherwise(weight)
    return weight


def _tag(prefix: str, kind: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.coalesce(kind, F.lit("None")))


def _located(df: DataFrame) -> DataFrame:
    """Rows with both coordinates; a coordinate of 0 counts as missing."""
    return df.where((F.col("lat") != 0.0) & (F.col("lon") != 0.0)).select(*SOURCE_COLUMNS)


def telemetry_source(positions: DataFrame, as_of: datetime | str, days: int = S.HEATMAP_DAYS) -> DataFrame:
    return telemetry_sample(positions, as_of, days).select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.lit("telemetry").alias("type"),
        F.lit(S.WEIGHT_TELEMETRY).alias("weight"),
    )


def event_source(
    events: DataFrame, as_of: datetime | str, days: int = S.HEATMAP_DAYS, weights: Mapping[str, float] = EVENT_WEIGHTS
) -> DataFrame:
    rows = recent(events, "created_at", as_of, days=days)
    return _located(
        rows.select(
            json_number(F.col("metadata"), "latitude", "lat").alias("lat"),
            json_number(F.col("metadata"), "longitude", "lon").alias("lon"),
            _tag("event", F.col("event_type")).alias("type"),
            _weight(F.col("event_type"), weights).alias("weight"),
        )
    )


def alert_source(
    alerts: DataFrame, as_of: datetime | str, days: int = S.HEATMAP_DAYS, weights: Mapping[str, float] = ALERT_WEIGHTS
) -> DataFrame:
    rows = recent(alerts, "created_at", as_of, days=days)
    return _located(
        rows.select(
            json_number(F.col("metadata"), "latitude", "lat").alias("lat"),
            json_number(F.col("metadata"), "longitude", "lon").alias("lon"),
            _tag("alert", F.col("alert_type")).alias("type"),
            _weight(F.col("severity"), weights).alias("weight"),
        )
    )


def anomaly_source(anomalies: DataFrame, as_of: datetime | str, days: int = S.HEATMAP_DAYS) -> DataFrame:
    rows = recent(anomalies, "detected_at", as_of, days=days).where("is_anomaly")
    return _located(
        rows.select(
            F.col("latitude").alias("lat"),
            F.col("longitude").alias("lon"),
            F.lit("ml_anomaly").alias("type"),
            F.col("anomaly_score").alias("weight"),
        )
    )


def all_sources(
    positions: DataFrame,
    events: DataFrame,
    alerts: DataFrame,
    anomalies: DataFrame,
    as_of: datetime | str,
    days: int = S.HEATMAP_DAYS,
) -> DataFrame:
    parts = [
        telemetry_source(positions, as_of, days),
        event_source(events, as_of, days),
        anomaly_source(anomalies, as_of, days),
        alert_source(alerts, as_of, days),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def cell_totals(points: DataFrame, resolution: int = S.HEX_RESOLUTION) -> DataFrame:
    """Weight and count per cell, summed before the shuffle."""
    q, r = hexgrid.cell_of(F.col("lat"), F.col("lon"), resolution)
    return points.groupBy(q.alias("q"), r.alias("r")).agg(
        F.sum("weight").alias("total_weight"), F.count("type").alias("event_count")
    )


def with_risk_zones(totals: DataFrame, zone_cells: DataFrame) -> DataFrame:
    """Raise cells inside risk zones, and add the zones' cells that have no data.

    The factor is the same for all rows of a cell, so it is applied to cell sums: the join meets one row
    per cell instead of every point.
    """
    zones = zone_cells.select("q", "r", F.lit(True).alias("_zone"))
    factor = F.when(F.col("_zone"), F.lit(S.ZONE_MULTIPLIER)).otherwise(F.lit(1.0))
    empty = F.col("event_count").isNull()
    return totals.join(zones, ["q", "r"], "full").select(
        "q",
        "r",
        F.when(empty, F.lit(S.ZONE_WEIGHT)).otherwise(F.col("total_weight") * factor).alias("total_weight"),
        F.coalesce("event_count", F.lit(1)).alias("event_count"),
    )


def intensities(totals: DataFrame, resolution: int = S.HEX_RESOLUTION) -> DataFrame:
    """Log-scaled weight relative to the heaviest cell; faint cells are dropped."""
    heaviest = totals.agg(F.max("total_weight")).scalar()
    weight = F.coalesce("total_weight", F.lit(0.0))
    intensity = F.when(heaviest > 0.0, F.round(F.log1p(weight) / F.log1p(heaviest), 4)).otherwise(F.lit(0.0))
    lat, lon = hexgrid.cell_center(F.col("q"), F.col("r"), resolution)
    return (
        totals.withColumn("intensity", intensity)
        .where(F.col("intensity") > S.MIN_INTENSITY)
        .select(
            hexgrid.cell_id(F.col("q"), F.col("r"), resolution).alias("h3_cell"),
            lat.alias("lat"),
            lon.alias("lon"),
            "intensity",
            "event_count",
        )
    )


def fleet_heatmap(
    positions: DataFrame,
    events: DataFrame,
    alerts: DataFrame,
    anomalies: DataFrame,
    risk_zones: DataFrame,
    as_of: datetime | str,
    days: int = S.HEATMAP_DAYS,
    resolution: int = S.HEX_RESOLUTION,
) -> DataFrame:
    totals = cell_totals(all_sources(positions, events, alerts, anomalies, as_of, days), resolution)
    return intensities(with_risk_zones(totals, hex_cells_of_shapes(risk_zones, resolution)), resolution)
