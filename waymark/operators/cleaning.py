"""Cleaning of raw positions, per device and UTC day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.geo import haversine_m
from waymark.functions.scalars import clip
from waymark.operators.quantiles import exact_quantile
from waymark.operators.ranking import with_previous

DAY = ["device_id", "date"]
SENSORS = ("speed", "heading", "altitude", "accuracy")


def deduplicate(positions: DataFrame) -> DataFrame:
    """One row per device, day and timestamp: the lowest id.

    An aggregate, so copies collapse before the shuffle. Its struct carries all columns to every
    reader, which lets the branches of the cleaning plan share one shuffle.
    """
    rest = [c for c in positions.columns if c not in ("device_id", "recorded_at")]
    kept = (
        positions.withColumn("date", F.to_date("recorded_at"))
        # joins further on would add this filter to some branches only, which would then not share the shuffle
        .where(F.col("device_id").isNotNull() & F.col("date").isNotNull())
        .groupBy(*DAY, "recorded_at")
        .agg(F.min_by(F.struct(*rest), "id").alias("_row"))
    )
    return kept.select(*DAY, "recorded_at", "_row.*")


def with_coordinates(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["latitude", "longitude"])


def day_medians(df: DataFrame, columns: Sequence[str] = SENSORS) -> DataFrame:
    """Exact median of each sensor per device and day, as columns `median_<sensor>`."""
    readings = df.select(*DAY, *[F.col(c).cast("double").alias(c) for c in columns])
    if len(columns) == 1:
        return exact_quantile(readings, DAY, columns[0], 0.5, f"median_{columns[0]}")
    long = readings.unpivot(DAY, list(columns), "sensor", "reading")
    by_sensor = exact_quantile(long, [*DAY, "sensor"], "reading", 0.5, "median")
    return by_sensor.groupBy(*DAY).agg(
        *[F.max(F.when(F.col("sensor") == c, F.col("median"))).alias(f"median_{c}") for c in columns]
    )


def fill_gaps(df: DataFrame, medians: DataFrame, columns: Sequence[str] = SENSORS) -> DataFrame:
    """Replace NULL readings by the median of the device's day.

    Medians are spread over the hours of the day before the join, so rows laid out by
    (device, day, hour) stay where they are and a busy day is not one task.
    """
    hourly = medians.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    filled = {c: F.coalesce(c, f"median_{c}") for c in columns}
    return df.join(hourly, [*DAY, "hour"], "left").withColumns(filled).drop(*[f"median_{c}" for c in columns])


def with_step_distance(df: DataFrame, keys: Sequence[str], slot: str, order: Sequence[str]) -> DataFrame:
    """Add `dist_from_prev`: metres from the row before; 0 for the first row."""
    joined = with_previous(df, keys, slot, order, ["latitude", "longitude"])
    step = haversine_m(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
    first = F.col("prev_latitude").isNull() | F.col("prev_longitude").isNull()
    return joined.withColumn("dist_from_prev", F.when(first, F.lit(0.0)).otherwise(step)).drop(
        "prev_latitude", "prev_longitude"
    )


def clean_positions(positions: DataFrame, fill: Sequence[str] = SENSORS) -> DataFrame:
    """Deduplicate, drop missing coordinates, clip speed, fill gaps, measure steps, drop teleports.

    The step is measured against the row before, spike or not, so a spike removes itself and the
    point after it. Medians are those of the day before that filter. `fill` names the sensors a caller
    reads; medians of others are not computed.
    """
    speed = clip(F.col("speed"), 0.0, S.MAX_SPEED_KMH)
    rows = with_coordinates(deduplicate(positions)).withColumns({"speed": speed, "hour": F.hour("recorded_at")})
    steps = with_step_distance(rows, DAY, "hour", ["recorded_at"])
    return fill_gaps(steps.where(F.col("dist_from_prev") < S.TELEPORT_M), day_medians(rows, fill), fill)
