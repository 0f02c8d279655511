"""Anomaly models: training per device, batch scoring, and the additive real-time score."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.scalars import as_timestamp, batch_score, risk_level, version_tag
from waymark.operators import forest
from waymark.operators.spatial import nearest_zone
from waymark.plans.anomalies import latest_models
from waymark.plans.routes import explode_routes
from waymark.sources.scans import active_devices, recent, recent_positions, sensor_positions, stored_routes

ROUTE_MODEL, SENSOR_MODEL = "IsolationForest", "SensorForest"


def route_features(
    segments: DataFrame, as_of: datetime | str, days: int = S.TRAINING_DAYS
) -> DataFrame:
    """Training rows from stored routes. Heading, altitude, accuracy and step distance are not stored with
    a route; as constants no tree could split on them, so they are left out of the model altogether."""
    points = explode_routes(stored_routes(segments, as_of, days))
    return points.select(
        "device_id",
        "recorded_at",
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
        F.col("hour").cast("double").alias("hour"),
        F.coalesce("speed", F.lit(0.0)).alias("speed"),
    )


def _register(
    trained: tuple[DataFrame, DataFrame], kind: str, as_of: datetime | str, first_day
) -> tuple[DataFrame, DataFrame]:
    """Add id, kind, period and time to models, and the model id and training day to their trees."""
    models, forests = trained
    created = as_timestamp(as_of)
    today = F.to_date(created)
    identity = F.xxhash64(F.lit(kind), version_tag(today, F.col("device_id")), F.lit(str(as_of)))
    models = models.select(
        identity.alias("id"),
        "device_id",
        F.lit(kind).alias("model_type"),
        first_day(today).alias("trained_from"),
        today.alias("trained_to"),
        created.alias("created_at"),
        "features",
        "n_samples",
        "means",
        "deviations",
        "threshold",
    )
    return models, forests.withColumns({"model_id": identity, "trained_to": today})


def train_route_models(
    segments: DataFrame,
    as_of: datetime | str,
    devices: DataFrame | None = None,
    days: int = S.TRAINING_DAYS,
    trees: int = S.TREES,
) -> tuple[DataFrame, DataFrame]:
    """Models of all (active, if devices are given) devices with at least 50 route points."""
    rows = route_features(segments, as_of, days)
    rows = rows if devices is None else active_devices(rows, devices)
    trained = forest.train(rows, S.ROUTE_FEATURES, "recorded_at", trees)
    return _register(trained, ROUTE_MODEL, as_of, lambda today: F.date_sub(today, days))


def train_sensor_models(
    positions: DataFrame, as_of: datetime | str, days: int = S.SENSOR_DAYS, trees: int = S.SENSOR_TREES
) -> tuple[DataFrame, DataFrame]:
    """Models of sensor readings; their period is given as starting with the month."""
    trained = forest.train(sensor_positions(positions, as_of, days), S.SENSOR_FEATURES, "id", trees)
    return _register(trained, SENSOR_MODEL, as_of, lambda today: F.trunc(today, "month"))


def training_status(devices: DataFrame, rows: DataFrame, least: int = S.MIN_TRAINING_ROWS) -> DataFrame:
    """Outcome per active device: trained, or skipped for want of rows."""
    counts = rows.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_samples"))
    active = devices.where(F.col("status") == "active").select(F.col("id").alias("device_id"))
    n = F.coalesce("n_samples", F.lit(0))
    return active.join(counts, "device_id", "left").select(
        "device_id", n.alias("n_samples"), F.when(n >= least, "TRAINED").otherwise("SKIPPED").alias("status")
    )


def current(models: DataFrame, forests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Newest model of a kind per device, and its trees; trees are stored by training day, so other days are pruned."""
    newest = latest_models(models, kind)
    wanted = newest.select("device_id", F.col("id").alias("model_id"), "trained_to")
    return newest, forests.join(wanted, ["device_id", "model_id", "trained_to"], "left_semi")


def score_points(points: DataFrame, models: DataFrame, forests: DataFrame, keep_unscored: bool = False) -> DataFrame:
    """Decision, label and model id of route models for points (id, device_id, recorded_at, latitude, longitude, speed)."""
    newest, trees = current(models, forests, ROUTE_MODEL)
    rows = points.withColumn("hour", F.hour("recorded_at"))
    carry = ["recorded_at", "latitude", "longitude"]
    return forest.apply(rows, newest, trees, S.ROUTE_FEATURES, "id", carry, keep_unscored=keep_unscored)


def score_recent(
    positions: DataFrame, models: DataFrame, forests: DataFrame, as_of: datetime | str, hours: int = S.SCORING_HOURS
) -> DataFrame:
    """Batch scoring of raw recent points, as anomaly rows."""
    points = recent_positions(positions, as_of, hours).select(
        "id", "device_id", "recorded_at", "latitude", "longitude", "speed"
    )
    scored = score_points(points, models, forests)
    score = batch_score(F.col("decision"))
    level = risk_level(F.col("anomaly_score"))
    return scored.withColumn("anomaly_score", score).select(
        "id",
        "device_id",
        "latitude",
        "longitude",
        "anomaly_score",
        (F.col("label") == -1).alias("is_anomaly"),
        F.col("recorded_at").alias("detected_at"),
        F.to_json(
            F.struct(level.alias("risk_level"), "model_id", (F.col("decision")).alias("raw_score"))
        ).alias("metadata"),
    )


def score_sensors(
    positions: DataFrame, models: DataFrame, forests: DataFrame, as_of: datetime | str, days: int = 1
) -> DataFrame:
    """Sensor scoring: the negated decision, unclipped, detected at `as_of`. A missing location stays missing."""
    newest, trees = current(models, forests, SENSOR_MODEL)
    rows = recent(positions, "recorded_at", as_of, days=days)
    scored = forest.apply(rows, newest, trees, S.SENSOR_FEATURES, "id", ["latitude", "longitude"])
    return scored.select(
        "id",
        "device_id",
        "latitude",
        "longitude",
        (-F.col("decision")).alias("anomaly_score"),
        (F.col("label") == -1).alias("is_anomaly"),
        as_timestamp(as_of).alias("detected_at"),
        F.to_json(F.struct(F.lit(ROUTE_MODEL).alias("source"), "model_id")).alias("metadata"),
    )


def additive_score(points: DataFrame) -> DataFrame:
    """Real-time rule on rows with a forest `label` and zone context.

    A NULL label means the device has no model: no score, risk unknown.
    """
    forest_part = F.when(F.col("label") == -1, F.lit(S.FOREST_SCORE)).otherwise(F.lit(0.0))
    in_main = F.col("inside_cluster") & (F.coalesce("nearest_cluster_label", F.lit("")) == "main")
    forest_part = (
        F.when(in_main, F.lit(0.0))
        .when(F.col("inside_cluster"), F.least(forest_part, F.lit(S.SECONDARY_ZONE_SCORE)))
        .otherwise(forest_part)
    )
    distance_part = (
        F.when(F.col("min_distance") > S.FAR_M, F.lit(S.FAR_SCORE))
        .when(F.col("min_distance") > S.NEAR_M, F.lit(S.NEAR_SCORE))
        .otherwise(F.lit(0.0))
    )
    known = F.col("label").isNotNull()
    return (
        points.withColumns(
            {"if_score_contrib": F.when(known, forest_part), "dist_score_contrib": F.when(known, distance_part)}
        )
        .withColumn("anomaly_score", F.round(F.col("if_score_contrib") + F.col("dist_score_contrib"), 2))
        .withColumns(
            {
                "is_anomaly": F.coalesce(F.col("anomaly_score") >= S.ALERT_SCORE, F.lit(False)),
                "risk_level": risk_level(F.col("anomaly_score")),
            }
        )
    )


def score_live(points: DataFrame, zones: DataFrame, models: DataFrame, forests: DataFrame) -> DataFrame:
    """Additive score of points as they come in: forest label, zone context, rule."""
    located = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    located = located.select("id", "device_id", "recorded_at", "latitude", "longitude", "speed")
    labels = score_points(located, models, forests, keep_unscored=True).drop("decision")
    return additive_score(nearest_zone(labels, zones, places=located))


def as_anomaly_rows(scored: DataFrame) -> DataFrame:
    """Live scores in the shape of the anomaly table; points without a model are not stored."""
    known = scored.where(F.col("anomaly_score").isNotNull())
    return known.select(
        "id",
        "device_id",
        "latitude",
        "longitude",
        "anomaly_score",
        "is_anomaly",
        F.col("recorded_at").alias("detected_at"),
        F.to_json(F.struct("risk_level", "model_id")).alias("metadata"),
    )


def confirmations(scored: DataFrame) -> DataFrame:
    """Answer to "should this point raise an alert?"."""
    return scored.select(
        "id",
        "device_id",
        F.col("is_anomaly").alias("should_alert"),
        "risk_level",
        "anomaly_score",
        F.when(F.col("anomaly_score").isNull(), "No trained model for this device").alias("reason"),
    )
