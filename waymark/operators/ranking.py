"""Latest-per-key, top-k and previous-row operators that hold when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import tabled
from waymark.settings import TOP_K_SPREAD


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_on: Sequence[str],
    rank: str = "rank",
    spread: int = TOP_K_SPREAD,
) -> DataFrame:
    """First `k` rows per key, with their 1-based rank.

    Two stages: every key is cut into `spread` groups, each keeps its own first `k`, and only those
    survivors meet under the key. Up to a `k` of 1000 Spark also limits each group before either shuffle; for more,
    `top_k_early` cuts before the first one.
    """
    part = Window.partitionBy(*keys, "_part").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", F.pmod(F.xxhash64(*spread_on), F.lit(spread)))
        .withColumn(rank, F.row_number().over(part))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
        .drop("_part")
    )


def newest_rows(df: DataFrame, key: str, time: str = "recorded_at", tie: str = "id", join_back: bool = False) -> DataFrame:
    """One row per key: the newest by `time`, of equal times the one with the highest `tie`, which tells rows of a key apart.

    Time and tie make one decimal number, so that columns of fixed width go through a hash aggregate, with one row per key
    and task to shuffle and nothing to sort. Strings and arrays cannot be held there: with `join_back` they are fetched by
    a join on (key, tie) with the newest rows, whose size Spark sees; else the whole row is aggregated by sorting, which
    suits streams and small tables.
    """
    rest = [c for c in df.columns if c != key]
    least = F.lit(-(2**62))
    order = F.coalesce(F.unix_micros(time), least).cast("decimal(20,0)") * F.expr("CAST(18446744073709551616 AS DECIMAL(20,0))")
    order = order + F.coalesce(F.col(tie), least).cast("decimal(20,0)")
    fixed = [c for c in rest if isinstance(df.schema[c].dataType, (T.NumericType, T.DatetimeType, T.BooleanType))]
    ranked = df.withColumn("_order", order)
    if len(fixed) < len(rest) and not join_back:
        row = F.max_by(F.struct(*rest), "_order").alias("_row")
        return ranked.groupBy(key).agg(row).select(key, "_row.*").select(*df.columns)
    newest = ranked.groupBy(key).agg(*[F.max_by(F.col(c), F.col("_order")).alias(c) for c in fixed])
    if len(fixed) == len(rest):
        return newest.select(*df.columns)
    newest = tabled(newest)
    own = newest.select(F.col(key).alias("_key"), F.col(tie).alias("_tie"))
    wide = df.join(own, F.col(key).eqNullSafe(F.col("_key")) & F.col(tie).eqNullSafe(F.col("_tie")))
    wide = wide.groupBy("_key", "_tie").agg(*[F.max(c).alias(c) for c in rest if c not in fixed])
    joined = newest.join(wide, F.col(key).eqNullSafe(F.col("_key")) & F.col(tie).eqNullSafe(F.col("_tie")))
    return joined.select(*df.columns)


def top_k_early(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    coarse: Column,
    spread_on: Sequence[str],
    rank: str = "rank",
) -> DataFrame:
    """`top_k` for a large `k`: rows that cannot be among the first `k` of their key go before anything is shuffled.

    `coarse` is a step function that grows with the order (the minute of a time, say). Rows per key and step are counted
    map-side; the first step at which a key has `k` rows is its limit. So about `k` rows and those of one more step are
    shuffled per key, whatever it has. Rows whose step is null sort last and are kept only by keys short of `k`.
    """
    stepped = df.withColumn("_step", coarse)
    sizes = stepped.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy(F.col("_step").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(running), F.lit(0))
    reached = sizes.withColumn("_before", before).where(F.col("_before") < k)
    last = F.max("_step").alias("_last")
    limits = tabled(reached.groupBy(*keys).agg(last, F.bool_or(F.col("_step").isNull()).alias("_all")))
    of_key = [F.col(name).alias(f"_of_{name}") for name in keys]
    same = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in keys])
    near = stepped.join(limits.select(*of_key, "_last", "_all"), same).where(F.col("_all") | (F.col("_step") <= F.col("_last")))
    return top_k(near.select(*df.columns), keys, order, k, spread_on, rank)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    order: Sequence[str],
    carry: Sequence[str],
) -> DataFrame:
    """Add `prev_<c>`: the value of `c` in the row before, within `keys`.

    `slot` is a coarse, increasing function of the first order column (an hour, say). Rows are shuffled
    and sorted by (keys, slot), so a busy key is spread over its slots; only one row per slot, the
    last, travels to the next non-empty slot of the key.
    """
    inside = Window.partitionBy(*keys, slot).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(slot)
    latest = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    tails = df.groupBy(*keys, slot).agg(*[F.max_by(c, latest).alias(f"_tail_{c}") for c in carry])
    before = tails.select(*keys, slot, *[F.lag(f"_tail_{c}").over(across).alias(f"_before_{c}") for c in carry])
    rows = df.select(
        *df.columns,
        (F.row_number().over(inside) == 1).alias("_opens"),
        *[F.lag(c).over(inside).alias(f"_inside_{c}") for c in carry],
    )
    return rows.join(before, [*keys, slot], "left").select(
        *df.columns,
        *[F.when(F.col("_opens"), F.col(f"_before_{c}")).otherwise(F.col(f"_inside_{c}")).alias(f"prev_{c}") for c in carry],
    )
