"""Reports on scored points and models, for all devices at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.functions.scalars import json_risk, ratio
from waymark.operators.ranking import newest_rows, top_k, top_k_early
from waymark.sources.scans import located, recent


def _newest():
    return [F.col("detected_at").desc_nulls_last(), F.col("id").desc()]


def anomaly_rows(
    anomalies: DataFrame,
    as_of: datetime | str,
    hours: int = S.REPORT_HOURS,
    only_anomalies: bool = False,
    risk: str | None = None,
) -> DataFrame:
    rows = recent(anomalies, "detected_at", as_of, hours=hours).withColumn("risk_level", json_risk(F.col("metadata")))
    if only_anomalies:
        rows = rows.where("is_anomaly")
    if risk is not None:
        rows = rows.where(F.col("risk_level") == risk)
    return rows.select(
        "id", "device_id", "latitude", "longitude", "anomaly_score", "is_anomaly", "risk_level", "detected_at"
    )


def anomaly_report(
    anomalies: DataFrame,
    as_of: datetime | str,
    hours: int = S.REPORT_HOURS,
    only_anomalies: bool = False,
    risk: str | None = None,
    limit: int = S.ANOMALY_LIMIT,
) -> DataFrame:
    """Scored points per device, newest first: at most `limit` (bounded by 2000), or all of one risk level."""
    rows = anomaly_rows(anomalies, as_of, hours, only_anomalies, risk)
    if risk is None:
        limit = min(limit, S.ANOMALY_LIMIT_MAX)
        if limit <= S.PLANNED_LIMIT:
            rows = top_k(rows, ["device_id"], _newest(), limit, ["id"])
        else:  # newest first: the steps grow as times fall
            rows = top_k_early(rows, ["device_id"], _newest(), limit, -F.unix_timestamp(F.date_trunc("minute", "detected_at")), ["id"])
        rows = rows.drop("rank")
    return rows.orderBy("device_id", *_newest())


def report_counts(report: DataFrame, flag: Column | None = None) -> DataFrame:
    """Rows, and rows that are anomalies, of a report per device: what goes with its rows.

    A report without scores has a count alone; `flag` says which rows are anomalies where no column does.
    """
    if flag is None and "is_anomaly" in report.columns:
        flag = F.col("is_anomaly")
    counts = [F.count(F.lit(1)).alias("count")]
    return report.groupBy("device_id").agg(*counts, *([] if flag is None else [F.count_if(flag).alias("anomaly_count")]))


def device_anomalies(anomalies: DataFrame, limit: int = S.DEVICE_ANOMALY_LIMIT) -> DataFrame:
    """Newest scored points per device, whatever their age, newest first."""
    columns = ["id", "device_id", "latitude", "longitude", "anomaly_score", "is_anomaly", "detected_at", "metadata"]
    rows = top_k(anomalies.select(*columns), ["device_id"], _newest(), limit, ["id"]).drop("rank")
    return rows.orderBy("device_id", *_newest())


def heat_points(
    anomalies: DataFrame,
    as_of: datetime | str,
    hours: int = S.SCORING_HOURS,
    min_score: float = 0.0,
    sampling: int = 1,
    limit: int = S.HEAT_POINT_LIMIT,
) -> DataFrame:
    """Oldest `limit` points per device: all anomalies, and every `sampling`-th of the rows otherwise."""
    rows = located(recent(anomalies, "detected_at", as_of, hours=hours)).where(F.col("anomaly_score") >= min_score)
    rows = rows.select("id", "device_id", "latitude", "longitude", "anomaly_score", "is_anomaly", "detected_at")
    order = [F.col("detected_at"), F.col("id")]
    if limit <= S.PLANNED_LIMIT:
        oldest = top_k(rows, ["device_id"], order, limit, ["id"])
    else:
        oldest = top_k_early(rows, ["device_id"], order, limit, F.date_trunc("minute", "detected_at"), ["id"])
    index = F.col("rank") - 1
    return oldest.where(F.col("is_anomaly") | (index % max(1, sampling) == 0)).select(
        "id",
        "device_id",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        F.col("anomaly_score").alias("weight"),
        F.when(F.col("is_anomaly"), "anomalous").otherwise("normal").alias("kind"),
    )


def latest_models(models: DataFrame, model_type: str | None = None) -> DataFrame:
    """Newest model per device (highest id among equal times)."""
    rows = models if model_type is None else models.where(F.col("model_type") == model_type)
    return newest_rows(rows, "device_id", "created_at")


def device_summary(
    anomalies: DataFrame, models: DataFrame, as_of: datetime | str, hours: int = S.REPORT_HOURS
) -> DataFrame:
    """Totals, rate and risk distribution per device, with its newest model. A missing level counts as low."""
    level = F.coalesce(json_risk(F.col("metadata")), F.lit("low"))
    totals = (
        recent(anomalies, "detected_at", as_of, hours=hours)
        .groupBy("device_id")
        .agg(
            F.count(F.lit(1)).alias("total_points"),
            F.count_if("is_anomaly").alias("anomaly_count"),
            *[F.count_if(level == name).alias(f"risk_{name}") for name in ("low", "medium", "high")],
        )
        .withColumn("anomaly_rate", ratio(F.col("anomaly_count"), F.col("total_points"), 4))
    )
    newest = latest_models(models).select(
        "device_id",
        F.col("id").alias("model_id"),
        "model_type",
        "trained_from",
        "trained_to",
        F.col("created_at").alias("trained_at"),
    )
    return totals.join(newest, "device_id", "left")


def weekly_totals(anomalies: DataFrame, as_of: datetime | str) -> DataFrame:
    """Points, anomalies and rate (as text) of the last 7 days; devices without points give no row."""
    counts = (
        recent(anomalies, "detected_at", as_of, days=S.WEEK_DAYS)
        .groupBy("device_id")
        .agg(F.count(F.lit(1)).alias("total_points"), F.count_if("is_anomaly").alias("anomaly_count"))
    )
    rate = ratio(F.col("anomaly_count"), F.col("total_points"), 2, 100.0)
    return counts.withColumn("anomaly_rate", F.concat(rate.cast("string"), F.lit("%")))


def weekly_hours(anomalies: DataFrame, as_of: datetime | str) -> DataFrame:
    """Anomalies per device and hour of day over the last 7 days."""
    rows = recent(anomalies, "detected_at", as_of, days=S.WEEK_DAYS).where("is_anomaly")
    return rows.groupBy("device_id", F.hour("detected_at").alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def peak_hours(anomalies: DataFrame, as_of: datetime | str, k: int = S.PEAK_HOURS) -> DataFrame:
    order = [F.col("count").desc(), F.col("hour")]
    return top_k(weekly_hours(anomalies, as_of), ["device_id"], order, k, ["hour"], spread=1)


def weekly_trend(anomalies: DataFrame, as_of: datetime | str) -> DataFrame:
    """Points, anomalies and percentage per device and UTC day over the last 7 days."""
    return (
        recent(anomalies, "detected_at", as_of, days=S.WEEK_DAYS)
        .groupBy("device_id", F.to_date("detected_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("total_points"), F.count_if("is_anomaly").alias("anomaly_points"))
        .withColumn("percentage", ratio(F.col("anomaly_points"), F.col("total_points"), 2, 100.0))
    )


def scoring_summary(scored: DataFrame) -> DataFrame:
    """Job summary per device."""
    return scored.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("points_scored"), F.count_if("is_anomaly").alias("anomalies")
    )


def recent_routes(routes: DataFrame, limit: int = S.ROUTE_LIMIT) -> DataFrame:
    """Newest daily routes per device, newest first."""
    order = [F.col("date").desc()]
    columns = ["device_id", "date", "point_count", "total_distance", "avg_speed"]
    return top_k(routes.select(*columns), ["device_id"], order, limit, ["date"], spread=1).drop("rank").orderBy("device_id", *order)
