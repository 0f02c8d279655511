"""Scoring rules, clipping, JSON locations and time helpers, as Column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import settings as S


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def risk_level(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("unknown"))
        .when(score < S.RISK_MEDIUM, F.lit("low"))
        .when(score < S.RISK_HIGH, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def batch_score(decision: Column) -> Column:
    """Decision value of a forest (negative is anomalous) as a score in 0..1."""
    return F.round(clip(F.lit(0.5) - decision, 0.0, 1.0), 4)


def timestamp_of(text: Column) -> Column:
    """ISO-8601 text as a timestamp, NULL when it is not one."""
    return F.try_to_timestamp(text)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def hour_of_text(text: Column) -> Column:
    """Hour of ISO-8601 text; 0 when missing or malformed."""
    return F.coalesce(F.hour(timestamp_of(text)), F.lit(0))


def version_tag(date: Column, device_id: Column) -> Column:
    return F.concat_ws("_", F.date_format(date, "yyyyMMdd"), device_id.cast("string"))


def json_number(json: Column, *paths: str) -> Column:
    """First usable number among JSON fields; missing, empty and zero values do not count."""
    usable = []
    for path in paths:
        text = F.get_json_object(json, f"$.{path}")
        number = text.try_cast("double")
        usable.append(F.when(number != 0.0, number))
    return F.coalesce(*usable)


def json_risk(metadata: Column) -> Column:
    return F.get_json_object(metadata, "$.risk_level")


def as_timestamp(moment: datetime | str) -> Column:
    """An `as_of` argument, read in the session's zone (UTC)."""
    if isinstance(moment, datetime):
        moment = moment.isoformat()
    return F.lit(moment).cast("timestamp")


def since(as_of: datetime | str, days: int = 0, hours: int = 0) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def ratio(part: Column, whole: Column, digits: int, scale: float = 1.0) -> Column:
    """`part/whole`, rounded; 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(scale), whole.cast("double")), digits), F.lit(0.0))
