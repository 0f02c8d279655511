"""Frequent zones: clusters of the places where a vehicle stands or crawls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.geo import haversine_m
from waymark.functions.scalars import as_timestamp
from waymark.operators.clustering import dbscan
from waymark.plans.routes import explode_routes
from waymark.session import shared_dir
from waymark.sources.scans import stored_routes


def without_anomalies(points: DataFrame, anomalies: DataFrame, as_of: datetime | str, days: int) -> DataFrame:
    """Drop points at a place (5 decimals) where the device had a confirmed anomaly since the cutoff day."""
    midnight = F.date_trunc("day", as_timestamp(as_of))
    cutoff = midnight - F.make_dt_interval(days=F.lit(days))
    places = anomalies.where(
        F.col("is_anomaly")
        & (F.col("detected_at") >= cutoff)
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
    ).select("device_id", F.round("latitude", 5).alias("_lat5"), F.round("longitude", 5).alias("_lng5"))
    keyed = points.withColumns({"_lat5": F.round("latitude", 5), "_lng5": F.round("longitude", 5)})
    return keyed.join(places.distinct(), ["device_id", "_lat5", "_lng5"], "left_anti").drop("_lat5", "_lng5")


def slow_points(points: DataFrame, max_speed: float = S.SLOW_SPEED_KMH) -> DataFrame:
    return points.where(F.coalesce("speed", F.lit(0.0)) <= max_speed)


def one_per_place_and_hour(points: DataFrame, *digits: int) -> DataFrame:
    """First point per place, day and hour, with its own coordinates; a place is given by all the roundings."""
    place = [F.round(c, d).alias(f"_{c}{d}") for c in ("latitude", "longitude") for d in digits]
    kept = F.min_by(F.struct("latitude", "longitude"), "recorded_at").alias("_point")
    return (
        points.groupBy("device_id", "date", "hour", *place)
        .agg(F.min("recorded_at").alias("recorded_at"), kept)
        .select("device_id", "date", "hour", "recorded_at", "_point.*")
    )


def stop_points(
    segments: DataFrame, anomalies: DataFrame, as_of: datetime | str, days: int = S.TRAINING_DAYS
) -> DataFrame:
    """Points the zones are built from: slow, not anomalous, one per place, day and hour.

    Anomalies are excluded by place at 5 decimals, stops are thinned by place at 4. Points are first reduced
    to one per day, hour and place at both: the outcome is the same, and the thousands of rows of a parked
    vehicle do not meet the join.
    """
    days = days or S.TRAINING_DAYS
    points = slow_points(explode_routes(stored_routes(segments, as_of, days)))
    points = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    reduced = one_per_place_and_hour(points, 5, 4)
    return one_per_place_and_hour(without_anomalies(reduced, anomalies, as_of, days), 4)


def enough_points(points: DataFrame, least: int) -> DataFrame:
    """Points of devices that have at least `least` of them."""
    known = points.groupBy("device_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return points.join(known.select("device_id"), "device_id", "left_semi")


def cluster_points(stops: DataFrame, eps_m: float = S.EPS_M, min_samples: int = S.MIN_SAMPLES) -> DataFrame:
    """Cluster per stop point. Stops are far fewer than positions and read many times, so they are kept.

    Their rounding bounds a grid cell: about a hundred places times days times hours.
    """
    shared_dir(stops.sparkSession)
    stops = stops.checkpoint()
    usable = enough_points(stops, 2 * min_samples).withColumn("point", F.col("recorded_at"))
    return dbscan(usable, eps_m, min_samples).drop("point")


def summarise_zones(clustered: DataFrame, main: int = S.MAIN_ZONES) -> DataFrame:
    """One row per zone: centre, size, days visited, rank score, radius and label.

    Days are summed up first, so distinct days are a plain count.
    """
    members = clustered.where(F.col("cluster") >= 0)
    keys = ["device_id", "cluster"]
    daily = members.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latitude").alias("lat"), F.sum("longitude").alias("lng")
    )
    zones = daily.groupBy(*keys).agg(
        (F.sum("lat") / F.sum("n")).alias("centroid_lat"),
        (F.sum("lng") / F.sum("n")).alias("centroid_lng"),
        F.sum("n").alias("point_count"),
        F.count(F.lit(1)).alias("frequent_days"),
    )
    reach = haversine_m(F.col("latitude"), F.col("longitude"), F.col("centroid_lat"), F.col("centroid_lng"))
    radii = (
        members.select(*keys, "latitude", "longitude")
        .join(zones.select(*keys, "centroid_lat", "centroid_lng"), keys)
        .groupBy(*keys)
        .agg(F.round(F.max(reach), 1).alias("radius"))
    )
    ranked = Window.partitionBy("device_id").orderBy(F.col("ranking_score").desc(), F.col("cluster"))
    return (
        zones.join(radii, keys)
        .withColumn("ranking_score", F.col("point_count") * F.col("frequent_days"))
        .withColumn("label", F.when(F.row_number().over(ranked) <= main, "main").otherwise("secondary"))
        .select(
            "device_id",
            F.col("cluster").alias("cluster_id"),
            "centroid_lat",
            "centroid_lng",
            "point_count",
            "frequent_days",
            "ranking_score",
            "radius",
            F.col("point_count").cast("double").alias("density"),
            "label",
        )
    )


def cluster_counts(clustered: DataFrame) -> DataFrame:
    """Clusters and noise points per device."""
    per_cluster = clustered.groupBy("device_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return per_cluster.groupBy("device_id").agg(
        F.count_if(F.col("cluster") >= 0).cast("int").alias("n_clusters"),
        F.sum(F.when(F.col("cluster") < 0, F.col("n")).otherwise(0)).alias("n_noise"),
    )


def cluster_status(
    stops: DataFrame, clustered: DataFrame, min_samples: int = S.MIN_SAMPLES, devices: DataFrame | None = None
) -> DataFrame:
    """Outcome per device with stop points, or per active device: counts, or that there was not enough data."""
    sizes = stops.groupBy("device_id").agg(F.count(F.lit(1)).alias("stop_points"))
    if devices is not None:
        active = devices.where(F.col("status") == "active").select(F.col("id").alias("device_id"))
        sizes = active.join(sizes, "device_id", "left").withColumn("stop_points", F.coalesce("stop_points", F.lit(0)))
    return sizes.join(cluster_counts(clustered), "device_id", "left").select(
        "device_id",
        "stop_points",
        F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
        F.coalesce("n_noise", F.lit(0)).alias("n_noise"),
        F.when(F.col("stop_points") < 2 * min_samples, "insufficient_data").otherwise("ok").alias("status"),
    )


def zone_list(zones: DataFrame) -> DataFrame:
    return zones.select(
        "device_id",
        "cluster_id",
        F.coalesce("label", F.lit("secondary")).alias("label"),
        F.struct(F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng")).alias("centroid"),
        "radius",
        "density",
        "point_count",
        "updated_at",
    )


def by_density(report: DataFrame) -> DataFrame:
    """Per device, densest zones first; sorted by range across the cluster."""
    return report.orderBy("device_id", F.col("density").desc_nulls_first(), "cluster_id")


def zone_totals(zones: DataFrame) -> DataFrame:
    label = F.coalesce("label", F.lit("secondary"))
    return zones.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("total_clusters"), F.count_if(label == "main").alias("main_clusters")
    )


def zone_heatmap(zones: DataFrame) -> DataFrame:
    """Located zones weighted by their density relative to the device's densest (0 when that is 0)."""
    located = zones.where(F.col("centroid_lat").isNotNull() & F.col("centroid_lng").isNotNull())
    density = F.coalesce("density", F.lit(0.0))
    densest = located.groupBy("device_id").agg(F.max(density).alias("_max"))
    weight = F.coalesce(F.round(F.try_divide(density, F.col("_max")), 4), F.lit(0.0))
    return located.join(densest, "device_id").select(
        "device_id",
        F.col("centroid_lat").alias("lat"),
        F.col("centroid_lng").alias("lng"),
        weight.alias("weight"),
        "cluster_id",
        F.coalesce("label", F.lit("secondary")).alias("label"),
        "radius",
    )
