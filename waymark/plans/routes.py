"""Daily routes: raw positions to one summary per device and day, and the points in bounded segments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.scalars import as_timestamp, hour_of_text, iso_text
from waymark.operators.cleaning import DAY, clean_positions
from waymark.sources.scans import last_days, on_days

ROUTE_COLUMNS = ["id", "device_id", "recorded_at", "latitude", "longitude", "speed"]


def route_points(positions: DataFrame) -> DataFrame:
    """Cleaned points a route consists of. Only speed is filled; routes store no other sensor."""
    return clean_positions(positions.select(*ROUTE_COLUMNS), fill=["speed"])


def summarise_routes(points: DataFrame, min_points: int = S.MIN_ROUTE_POINTS) -> DataFrame:
    """Distance, mean speed and size of every device-day that has enough points."""
    return (
        points.groupBy(*DAY)
        .agg(
            F.count(F.lit(1)).alias("point_count"),
            F.round(F.sum("dist_from_prev"), 3).alias("total_distance"),
            F.coalesce(F.round(F.avg("speed"), 3), F.lit(0.0)).alias("avg_speed"),
        )
        .where(F.col("point_count") >= min_points)
    )


def daily_routes(positions: DataFrame) -> DataFrame:
    return summarise_routes(route_points(positions))


def skipped_days(points: DataFrame, min_points: int = S.MIN_ROUTE_POINTS) -> DataFrame:
    """Device-days with points, but too few for a route."""
    return (
        points.groupBy(*DAY)
        .agg(F.count(F.lit(1)).alias("point_count"))
        .where(F.col("point_count") < min_points)
        .withColumn("reason", F.lit("too_few_points"))
    )


def route_segments(points: DataFrame, min_points: int = S.MIN_ROUTE_POINTS) -> DataFrame:
    """Time-ordered points of every route, in arrays of at most `SEGMENT_POINTS`.

    A day's array has no upper size, so a route is stored as its hours, cut into numbered segments;
    (hour slot, segment) sorts them back into one path. Kept days are spread over their hours before the
    join, as in the median fill.
    """
    inside = Window.partitionBy(*DAY, "hour").orderBy("recorded_at")
    kept = (
        summarise_routes(points, min_points)
        .select(*DAY)
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    )
    numbered = (
        points.join(kept, [*DAY, "hour"], "left_semi")
        .withColumn("_n", F.row_number().over(inside) - 1)
        .withColumn("segment", F.floor(F.col("_n") / F.lit(S.SEGMENT_POINTS)))
    )
    # recorded_at leads the struct only for sorting; it is unique within a device-day
    point = F.struct("recorded_at", "latitude", "longitude", "speed")
    ordered = F.array_sort(F.collect_list(point))
    return (
        numbered.groupBy(*DAY, F.col("hour").alias("slot"), "segment")
        .agg(ordered.alias("_points"))
        .select(
            *DAY,
            "slot",
            "segment",
            F.transform(
                "_points",
                lambda p: F.struct(
                    p.latitude.alias("latitude"),
                    p.longitude.alias("longitude"),
                    p.speed.alias("speed"),
                    p.recorded_at.alias("recorded_at"),
                ),
            ).alias("points"),
        )
    )


def explode_routes(segments: DataFrame) -> DataFrame:
    """Stored routes back to points."""
    return segments.select(*DAY, F.inline("points")).withColumn("hour", F.hour("recorded_at"))


def routes_as_json(segments: DataFrame) -> DataFrame:
    """Segments with their points as JSON text, timestamps in ISO-8601."""
    body = F.transform(
        "points",
        lambda p: F.struct(
            p.latitude.alias("latitude"),
            p.longitude.alias("longitude"),
            p.speed.alias("speed"),
            iso_text(p.recorded_at).alias("recorded_at"),
        ),
    )
    return segments.select(*DAY, "slot", "segment", F.to_json(body).alias("route_json"))


def routes_from_json(stored: DataFrame) -> DataFrame:
    """Points of routes stored as JSON text; a missing or malformed time gives hour 0."""
    schema = "array<struct<latitude:double,longitude:double,speed:double,recorded_at:string>>"
    points = stored.select(*DAY, F.inline(F.from_json("route_json", schema)))
    return points.withColumn("hour", hour_of_text(F.col("recorded_at"))).withColumn(
        "recorded_at", F.try_to_timestamp("recorded_at")
    )


def routes_of_last_days(positions: DataFrame, as_of: datetime | str, days: int = S.TRAINING_DAYS) -> DataFrame:
    """Routes of the `days` full days before `as_of`; its own day is left out."""
    return daily_routes(last_days(positions, as_of, days))


def route_of_day(positions: DataFrame, stored: DataFrame, as_of: datetime | str, day: str) -> DataFrame:
    """Stored routes of one day; from `as_of`'s day on, devices without one are aggregated on demand."""
    wanted = F.lit(day).cast("date")
    found = stored.where(F.col("date") == wanted).select(
        "device_id", "date", "point_count", "total_distance", "avg_speed"
    )
    open_day = on_days(positions, day, day).where(wanted >= F.to_date(as_timestamp(as_of)))
    fresh = daily_routes(open_day.join(found.select("device_id"), "device_id", "left_anti"))
    return found.unionByName(fresh)
