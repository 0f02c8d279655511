"""The nightly job: aggregate days, train models, score the recent window; each step also alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.scalars import as_timestamp
from waymark.plans import anomalies, routes, scoring, zones
from waymark.sources import scans, store

STEPS = ("aggregate", "train", "infer")


@dataclass(frozen=True)
class Store:
    """Where the job keeps its tables."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def aggregate(positions: DataFrame, target: Store, as_of: datetime | str, days: int = S.TRAINING_DAYS) -> None:
    points = routes.route_points(scans.last_days(positions, as_of, days))
    store.save_routes(
        routes.summarise_routes(points),
        routes.route_segments(points),
        target.path("daily_routes"),
        target.path("route_segments"),
    )


def train(
    devices: DataFrame, target: Store, as_of: datetime | str, days: int = S.TRAINING_DAYS, trees: int = S.TREES
) -> None:
    spark = devices.sparkSession
    segments = store.read_table(spark, target.path("route_segments"), "route_segments")
    models, forests = scoring.train_route_models(segments, as_of, devices, days, trees)
    store.save_models(forests, target.path("forests"), "model_id")
    store.save_models(models, target.path("models"), "id")


def infer(
    positions: DataFrame, target: Store, as_of: datetime | str, hours: int = S.SCORING_HOURS
) -> DataFrame:
    """Score, store and return points and anomalies per device."""
    spark = positions.sparkSession
    models = store.read_table(spark, target.path("models"), "trained_models")
    forests = store.read_table(spark, target.path("forests"), "forests")
    scored = store.staged(scoring.score_recent(positions, models, forests, as_of, hours))
    store.save_scores(scored, scored, target.path("anomalies"), as_of, hours)
    return anomalies.scoring_summary(scored)


def route_of_day(positions: DataFrame, target: Store, as_of: datetime | str, day: str) -> DataFrame:
    """Routes of one day with their points, in segments: (device_id, date, total_distance, avg_speed, slot, segment, points).

    From `as_of`'s day on, device-days without a stored route are aggregated and stored first. Days before that are read
    as they are.
    """
    spark = positions.sparkSession
    paths = target.path("daily_routes"), target.path("route_segments")
    wanted = F.col("date") == F.lit(day).cast("date")
    if day >= spark.range(1).select(F.to_date(as_timestamp(as_of)).cast("string")).first()[0]:
        known = store.read_table(spark, paths[0], "daily_routes").where(wanted).select("device_id")
        missing = scans.on_days(positions, day, day).join(known, "device_id", "left_anti")
        points = store.staged(routes.route_points(missing))
        store.save_routes(routes.summarise_routes(points), routes.route_segments(points), *paths)
    summary = store.read_table(spark, paths[0], "daily_routes").where(wanted).drop("created_at", "point_count")
    segments = store.read_table(spark, paths[1], "route_segments").where(wanted)
    return summary.join(segments, ["device_id", "date"])


def refresh(
    positions: DataFrame,
    devices: DataFrame,
    target: Store,
    as_of: datetime | str,
    steps: Sequence[str] = STEPS,
    days: int = S.TRAINING_DAYS,
    hours: int = S.SCORING_HOURS,
    include_inactive: bool = False,
    trees: int = S.TREES,
) -> DataFrame | None:
    """Run the chosen steps for all active (or all known) devices."""
    positions = scans.active_devices(positions, devices, include_inactive)
    fleet = devices.withColumn("status", F.lit("active")) if include_inactive else devices
    if "aggregate" in steps:
        aggregate(positions, target, as_of, days)
    if "train" in steps:
        train(fleet, target, as_of, days, trees)
    return infer(positions, target, as_of, hours) if "infer" in steps else None


def refresh_zones(
    devices: DataFrame, target: Store, as_of: datetime | str, days: int = S.TRAINING_DAYS
) -> DataFrame:
    """Rebuild the zones of active devices from stored routes and scores; returns the outcome per device.

    Devices with too few stop points keep the zones they had; active devices without any have a row too.
    """
    spark = devices.sparkSession
    segments = scans.active_devices(
        store.read_table(spark, target.path("route_segments"), "route_segments"), devices
    )
    scored = store.read_table(spark, target.path("anomalies"), "anomalies")
    stops = store.staged(zones.stop_points(segments, scored, as_of, days))
    clustered = store.staged(zones.cluster_points(stops))
    store.save_zones(zones.summarise_zones(clustered), clustered, target.path("zones"))
    return zones.cluster_status(stops, clustered, devices=devices)
