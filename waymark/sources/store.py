"""Stored tables: idempotent writes on plain Parquet, and the readers that go with them.

A table is never read and overwritten in one plan: the merged rows are staged by a checkpoint in the
shared folder first.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.functions.scalars import since
from waymark.operators.changes import latest_changes, rejected_changes
from waymark.schemas import TABLES
from waymark.session import shared_dir

#: Dates that a plan lists one by one.
LISTED_DAYS = 1000


#: Stored tables whose schema has columns beyond the declared ones: the folders they are partitioned by.
FOLDERS = {"anomalies": "date date, batch string"}
#: The folder of rows that the nightly job wrote; live batches have folders of their own.
NIGHTLY = "nightly"


def _stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """The table at `path`, or None when nothing has been written there. The schema is given, never inferred."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its declared schema, and `date` where days are folders; empty when not there yet."""
    schema = ", ".join(filter(None, [TABLES[name], FOLDERS.get(name)]))
    stored = _stored(spark, path, schema)
    return (spark.createDataFrame([], schema) if stored is None else stored).drop("batch")


def staged(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _write_days(df: DataFrame, path: str, order: Sequence[str], folders: Sequence[str] = ("date",)) -> None:
    """Overwrite only the days present; rows are laid out by day, then by `order`, in few files per day."""
    laid_out = df.repartitionByRange("date", *order).sortWithinPartitions("date", *order)
    writer = laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).parquet(path)


def _drop_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Remove folders, and the folders around them that are empty then."""
    jvm = spark._jvm
    for name in folders:
        folder = jvm.org.apache.hadoop.fs.Path(name)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(folder, True)
        around = folder.getParent()
        if files.exists(around) and not any(not f.getPath().getName().startswith("_") for f in files.listStatus(around)):
            files.delete(around, True)


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches written below `path`, in order; a batch counts once it is committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*/_SUCCESS")) if files.exists(folder) else []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def drop_batches(spark: SparkSession, path: str, upto: int) -> None:
    _drop_folders(spark, [f"{path}/batch_id={n}" for n in batches(spark, path) if n <= upto])


def of_days(stored: DataFrame, days: DataFrame) -> DataFrame:
    """The stored rows of the dates in `days`; other partitions are not read.

    The dates go into the plan as a list, up to `LISTED_DAYS` of them; beyond that their span does, and a join.
    """
    dates = days.select("date").where("date IS NOT NULL").distinct()
    listed = [row["date"] for row in dates.limit(LISTED_DAYS + 1).collect()]
    if len(listed) <= LISTED_DAYS:
        return stored.where(F.col("date").isin(listed)) if listed else stored.limit(0)
    first, last = dates.agg(F.min("date"), F.max("date")).first()
    return stored.where(F.col("date").between(first, last)).join(dates, "date", "left_semi")


def replace_keys(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`fresh`, and the existing rows whose keys it does not have."""
    kept = existing.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def save_days(fresh: DataFrame, path: str, name: str, order: Sequence[str] = ("device_id",)) -> None:
    """Upsert by (device, date). Device-days without fresh rows keep what is stored.

    Only the days that `fresh` touches are read and rewritten.
    """
    spark = fresh.sparkSession
    fresh = staged(fresh)
    stored = read_table(spark, path, name)
    touched = of_days(stored, fresh)
    _write_days(staged(replace_keys(touched, fresh, ["device_id", "date"])), path, order)


def save_routes(summary: DataFrame, segments: DataFrame, summary_path: str, segments_path: str) -> None:
    save_days(summary.withColumn("created_at", F.current_timestamp()), summary_path, "daily_routes")
    save_days(segments, segments_path, "route_segments", ["device_id", "slot", "segment"])


def append(df: DataFrame, path: str) -> None:
    """History-keeping append: models, trees, scored points."""
    df.write.mode("append").parquet(path)


def save_models(fresh: DataFrame, path: str, identity: str) -> None:
    """Add models (or their trees) to the stored history, partitioned by training day.

    Rows of the same models are replaced: a repeated run with the same `as_of` leaves one model and one forest.
    """
    spark = fresh.sparkSession
    fresh = staged(fresh)
    stored = _stored(spark, path, fresh.schema)
    if stored is not None:
        days = fresh.select(F.col("trained_to").alias("date"))
        stored = of_days(stored.withColumn("date", F.col("trained_to")), days)
        kept = stored.join(fresh.select(identity).distinct(), identity, "left_anti")
        fresh = staged(kept.select(*fresh.columns).unionByName(fresh))
    laid_out = fresh.repartitionByRange("trained_to", "device_id").sortWithinPartitions("trained_to", "device_id")
    writer = laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("trained_to").parquet(path)


def replace_window(
    existing: DataFrame, fresh: DataFrame, processed: DataFrame, as_of: datetime | str, hours: int
) -> DataFrame:
    """`fresh`, older rows, and rows of devices that were not processed."""
    inside = F.col("detected_at") >= since(as_of, hours=hours)
    older = existing.where(~F.coalesce(inside, F.lit(False)))
    others = existing.where(inside).join(processed.select("device_id").distinct(), "device_id", "left_anti")
    return older.unionByName(others.select(*existing.columns)).unionByName(fresh)


def save_scores(fresh: DataFrame, processed: DataFrame, path: str, as_of: datetime | str, hours: int) -> None:
    """Replace the scored window of the processed devices, rewriting only the days it touches.

    Live batches of these days are folded into the nightly rows and their folders removed. Until that is done a reader
    may see folded rows twice; a run that was interrupted there is repaired by the next one.
    """
    spark = fresh.sparkSession
    fresh = staged(fresh.withColumn("date", F.to_date("detected_at")))
    stored = _stored(spark, path, f"{TABLES['anomalies']}, {FOLDERS['anomalies']}")
    if stored is None:
        stored = spark.createDataFrame([], f"{TABLES['anomalies']}, {FOLDERS['anomalies']}")
    touched = staged(stored.where(F.col("date") >= F.to_date(since(as_of, hours=hours))))
    folded = touched.where(F.col("batch") != NIGHTLY).select("date", "batch").distinct().collect()  # days x batches
    rows = touched.select(*fresh.columns)
    if folded:  # rows that an interrupted run had folded already are there twice
        rows = rows.dropDuplicates(["device_id", "id", "detected_at"])
    merged = staged(replace_window(rows, fresh, processed, as_of, hours))
    emptied = touched.select("date").distinct().join(merged.select("date").distinct(), "date", "left_anti").collect()
    _write_days(merged.withColumn("batch", F.lit(NIGHTLY)), path, ["device_id", "detected_at"], ["date", "batch"])
    gone = [f"{path}/date={row['date']}/batch={row['batch']}" for row in folded]
    _drop_folders(spark, gone + [f"{path}/date={row['date']}/batch={NIGHTLY}" for row in emptied])


def _ledger(path: str) -> str:
    return f"{path.rstrip('/')}/_ledger"


LEDGER = "stream string, batch_id bigint, rows bigint, newest timestamp"


def read_ledger(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """The batches of a stream that the table at `path` holds."""
    stored = _stored(spark, f"{_ledger(path)}/stream={stream}", "rows bigint, newest timestamp, batch_id bigint")
    if stored is None:
        stored = spark.createDataFrame([], "rows bigint, newest timestamp, batch_id bigint")
    return stored


def note_batch(spark: SparkSession, path: str, stream: str, batch_id: int, rows: int, newest: datetime | None) -> None:
    """Write into the ledger that a batch is done; `newest` is the latest time seen in it."""
    row = spark.createDataFrame([(rows, newest)], "rows bigint, newest timestamp")
    row.coalesce(1).write.mode("overwrite").parquet(f"{_ledger(path)}/stream={stream}/batch_id={batch_id}")


def append_scores(rows: DataFrame, path: str, stream: str, batch_id: int, newest: datetime | None = None) -> bool:
    """Add the scores of a micro-batch to the anomaly table; False if the ledger has the batch already.

    Every batch has a folder of its own in each day, so nothing stored is read or rewritten. A batch that is delivered
    again before it was noted overwrites its own folders; one that comes after that, even after the nightly job has
    folded it, is left out.
    """
    spark = rows.sparkSession
    if not read_ledger(spark, path, stream).where(F.col("batch_id") == batch_id).isEmpty():
        return False
    names = [part.split()[0] for part in TABLES["anomalies"].split(", ")]
    dated = rows.select(*names, F.to_date("detected_at").alias("date"), F.lit(f"{stream}-{batch_id}").alias("batch"))
    dated = staged(dated)
    _write_days(dated, path, ["device_id", "detected_at"], ["date", "batch"])
    note_batch(spark, path, stream, batch_id, dated.count(), newest)
    return True


def replace_devices(existing: DataFrame, fresh: DataFrame, processed: DataFrame) -> DataFrame:
    """`fresh`, and all rows of devices that were not processed."""
    kept = existing.join(processed.select("device_id").distinct(), "device_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def save_zones(zones: DataFrame, processed: DataFrame, path: str) -> None:
    """Replace all zones of the processed devices; rank scores and day counts are not stored."""
    now = F.current_timestamp()
    stored = zones.drop("frequent_days", "ranking_score").withColumns({"updated_at": now, "created_at": now})
    merged = staged(replace_devices(read_table(zones.sparkSession, path, "zones"), stored, processed))
    merged.repartitionByRange("device_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)


def save_heatmap(cells: DataFrame, path: str) -> None:
    """One JSON object per line, in cell order across the files."""
    cells.orderBy("h3_cell").write.mode("overwrite").json(path)


def heatmap_arrays(cells: DataFrame, tile: int = 64) -> DataFrame:
    """JSON arrays for map clients, one per tile of at most `tile` x `tile` cells."""
    q, r = F.split("h3_cell", ":")[1].cast("bigint"), F.split("h3_cell", ":")[2].cast("bigint")
    cell = F.struct("h3_cell", "lat", "lon", "intensity", "event_count")
    return (
        cells.groupBy(F.floor(q / tile).alias("tile_q"), F.floor(r / tile).alias("tile_r"))
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        .select("tile_q", "tile_r", F.to_json("cells").alias("value"))
    )


def save_heatmap_arrays(cells: DataFrame, path: str) -> None:
    heatmap_arrays(cells).select("value").write.mode("overwrite").text(path)


def read_heatmap(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """A heatmap as rows: JSON lines, an array per line, or (`whole_file`) one array per file."""
    reader = spark.read.schema(TABLES["heatmap"])
    return (reader.option("multiLine", True) if whole_file else reader).json(path)


def apply_feed(
    spark: SparkSession, path: str, name: str, feed: DataFrame, feed_id: int, key: str, value: str, valid: Column
) -> DataFrame:
    """Store the newest valid change per key of a feed beside the undated table at `path`; returns what it rejects.

    The table itself is not rewritten: a feed is a small delta in a folder under its number, so a second delivery
    replaces itself. Feeds count in the order of their numbers, whenever they arrive.
    """
    table = read_table(spark, path, name)
    known = table.select(F.col("id").alias("_key"))
    changes = latest_changes(feed, key, value, valid).join(known, "_key", "left_semi")
    changes.write.mode("overwrite").parquet(f"{path.rstrip('/')}_changes/{value}/feed_id={feed_id}")
    return rejected_changes(table, feed, key, valid)


def read_changed(spark: SparkSession, path: str, name: str, value: str) -> DataFrame:
    """The undated table at `path` with the changes of `value` that feeds have brought."""
    table = read_table(spark, path, name)
    kind = table.schema[value].dataType.simpleString()
    changes = _stored(spark, f"{path.rstrip('/')}_changes/{value}", f"_key bigint, _new {kind}, feed_id bigint")
    if changes is None:
        return table
    newest = changes.groupBy("_key").agg(F.max_by("_new", "feed_id").alias("_new"))
    joined = table.join(newest, table["id"] == newest["_key"], "left")
    return joined.withColumn(value, F.coalesce("_new", value)).select(*table.columns)


def fold_feeds(spark: SparkSession, path: str, name: str, value: str) -> None:
    """Write the changes into the table. Their deltas stay until it is written, and applying them twice changes nothing."""
    merged = staged(read_changed(spark, path, name, value))
    merged.repartitionByRange("id").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    _drop_folders(spark, [f"{path.rstrip('/')}_changes/{value}"])
