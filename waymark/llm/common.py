"""Helpers shared by the corpus operators: staged tables, learning folds, text columns."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import shared_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and go on from the table.

    It cuts the lineage, and a join with the table can split hot keys, which it cannot above an aggregate.
    """
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(key: str, folds: int, fold: int) -> Column:
    """Rows whose crc32 of the key as text leaves `fold`: never learned from. A null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(True))


def sampled(rows: DataFrame, key: str, strata: str, bound: int) -> DataFrame:
    """About `bound` rows of each stratum, chosen by a hash of the key; all rows where there are fewer.

    For fitting only. The counts are exact and come from all rows; strata are few.
    """
    counts = rows.groupBy(strata).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(bound)) / F.col("_n")
    point = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(counts), strata).where(point < share).drop("_n")  # one row for each of few strata


def spare_names(rows: DataFrame, count: int) -> list[str]:
    """Column names that the rows do not have, whatever the case of theirs."""
    taken = {name.lower() for name in rows.columns}
    return [name for n in range(len(taken) + count) if (name := f"_own{n}") not in taken][:count]


def _ranges(codes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of neighbouring numbers."""
    for _, run in itertools.groupby(enumerate(codes), lambda pair: pair[1] - pair[0]):
        own = [code for _, code in run]
        yield own[0], own[-1]


#: Capitals of any script, as the inside of a character class.
CAPITALS = "".join(
    chr(low) if low == high else f"{chr(low)}-{chr(high)}" for low, high in _ranges(c for c in range(0x110000) if chr(c).isupper() or chr(c).istitle())
)
