"""Keyed updates from a change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_changes(feed: DataFrame, key: str, value: str, valid: Column) -> DataFrame:
    """Newest valid change per key (`changed_at`, then `id`)."""
    newest = F.max_by(value, F.struct("changed_at", "id")).alias("_new")
    return feed.where(valid).groupBy(F.col(key).alias("_key")).agg(newest)


def apply_changes(table: DataFrame, feed: DataFrame, key: str, value: str, valid: Column) -> DataFrame:
    """`table` (keyed by `id`) with `value` taken from its newest valid change; `updated` marks matched rows."""
    newest = latest_changes(feed, key, value, valid)
    joined = table.join(newest, table["id"] == newest["_key"], "left")
    return joined.withColumns({value: F.coalesce("_new", value), "updated": F.col("_key").isNotNull()}).drop(
        "_key", "_new"
    )


def rejected_changes(table: DataFrame, feed: DataFrame, key: str, valid: Column) -> DataFrame:
    """Changes that cannot apply, with the reason: a bad value, or a key the table lacks."""
    accepted = F.coalesce(valid, F.lit(False))
    invalid = feed.where(~accepted).withColumn("reason", F.lit("invalid_value"))
    keys = table.select(F.col("id").alias(key))
    unknown = feed.where(accepted).join(keys, key, "left_anti").withColumn("reason", F.lit("unknown_key"))
    return invalid.unionByName(unknown.select(*invalid.columns))
