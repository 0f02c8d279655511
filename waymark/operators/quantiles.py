"""Exact quantiles per key without gathering a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    alias: str,
    bucket_width: float = 1.0,
) -> DataFrame:
    """Quantile `q` of `value` per key, with linear interpolation; NULLs do not count.

    Equal values are counted map-side first. Bucket totals then show which bucket holds the wanted
    ranks, and only the distinct values of those buckets are ordered.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.floor(F.col("_v") / F.lit(bucket_width)))
        # the join below asks for this; said here, both uses of the counts stay the same and are computed once
        .where(F.col("_bucket").isNotNull())
        # one layout for the totals, the join and the window below
        .repartition(*[F.col(k) for k in keys], F.col("_bucket"))
    )
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_end", F.sum("_size").over(running))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
        .withColumn("_pos", F.lit(float(q)) * (F.col("_total") - 1))
        .withColumn("_lo", F.floor("_pos"))
        .withColumn("_hi", F.ceil("_pos"))
        .withColumn("_start", F.col("_end") - F.col("_size"))
        .where(
            F.col("_lo").between(F.col("_start"), F.col("_end") - 1)
            | F.col("_hi").between(F.col("_start"), F.col("_end") - 1)
        )
        .select(*keys, "_bucket", "_start", "_pos", "_lo", "_hi")
    )
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        counts.join(buckets, [*keys, "_bucket"])
        .withColumn("_end", F.col("_start") + F.sum("_n").over(within))
        .withColumn("_first", F.col("_end") - F.col("_n"))
    )
    low = F.max(F.when(F.col("_lo").between(F.col("_first"), F.col("_end") - 1), F.col("_v")))
    high = F.max(F.when(F.col("_hi").between(F.col("_first"), F.col("_end") - 1), F.col("_v")))
    share = F.max(F.col("_pos") - F.col("_lo"))
    return ranked.groupBy(*keys).agg((low + (high - low) * share).alias(alias))
