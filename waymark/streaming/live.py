"""Live jobs on a stream of positions.

Scoring runs as batch plans inside `foreachBatch`: the same code as the batch reports, with the zones and
models read anew for every micro-batch. Each batch is written to its own folder and overwritten when it
is delivered again, so results appear once; the anomaly table also keeps a ledger of the batches it holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.ranking import newest_rows
from waymark.plans import routes, scoring
from waymark.plans.tracking import vehicle_devices
from waymark.schemas import TABLES
from waymark.sources import store

Tables = Callable[[], tuple[DataFrame, DataFrame, DataFrame]]


def position_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Positions arriving as Parquet files."""
    reader = spark.readStream.schema(TABLES["positions"]).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def by_vehicle(points: DataFrame, devices: DataFrame) -> DataFrame:
    """Points that name a vehicle, with the device that speaks for it; unknown vehicles drop out."""
    return points.drop("device_id").join(vehicle_devices(devices), "vehicle_id")


def valid(points: DataFrame) -> DataFrame:
    """A point needs both coordinates; a missing speed counts as 0."""
    return points.dropna(subset=["latitude", "longitude"]).fillna(0.0, subset=["speed"])


def without_repeats(points: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop re-delivered points. Rows later than the watermark are dropped, and counted in the query's progress
    (`numRowsDroppedByWatermark`); the state holds one watermark's worth of keys."""
    return points.withWatermark("recorded_at", lateness).dropDuplicatesWithinWatermark(["device_id", "recorded_at"])


def _start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str, continuous: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def write_stream(
    stream: DataFrame, out: str, checkpoint: str, mode: str = "append", continuous: bool = True
) -> StreamingQuery:
    """Write every micro-batch to `out/batch_id=N`."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/batch_id={batch_id}")

    return _start(stream, handle, checkpoint, mode, continuous)


def _write_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/batch_id={batch_id}")


def score_stream(
    stream: DataFrame,
    tables: Tables,
    out: str,
    alerts_out: str,
    checkpoint: str,
    continuous: bool = True,
    score: Callable[..., DataFrame] = scoring.score_live,
    name: str = "live",
) -> StreamingQuery:
    """Score points as they arrive: rows for the anomaly table at `out`, points that should raise an alert to `alerts_out`."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        points = store.staged(valid(batch))  # scoring reads them more than once
        scored = store.staged(score(points, *tables()))
        _write_batch(scoring.confirmations(scored).where("should_alert"), alerts_out, batch_id)
        store.append_scores(scoring.as_anomaly_rows(scored), out, name, batch_id)

    return _start(stream, handle, checkpoint, "append", continuous)


@dataclass(frozen=True)
class Folders:
    """Where the whole live job keeps what it makes of a feed."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def with_first_deliveries(stream: DataFrame, key: str, lateness: str) -> DataFrame:
    """Every row as it came (`first` is false), and once more (`first` is true) if it is the first of its key and time.

    The second part passes the watermark deduplication; what it drops is found by comparing the two parts of a batch.
    """
    complete = stream.dropna(subset=[key, "recorded_at", "latitude", "longitude"])
    once = complete.withWatermark("recorded_at", lateness).dropDuplicatesWithinWatermark([key, "recorded_at"])
    return stream.withColumn("first", F.lit(False)).unionByName(once.withColumn("first", F.lit(True)))


def outcomes(batch: DataFrame, key: str, latest: datetime | None) -> DataFrame:
    """Rows of a batch that are not scored, with `copies` and `reason`; `latest` is the watermark the batch met."""
    own = [key, "recorded_at", "id"]
    counted = batch.groupBy(*own).agg(
        F.count_if(~F.col("first")).alias("came"), F.count_if("first").alias("passed"),
        F.bool_or(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("nowhere"),
    )
    late = F.lit(False) if latest is None else F.col("recorded_at") <= F.lit(latest)
    reason = (
        F.when(F.col(key).isNull(), "unknown_vehicle").when(F.col("recorded_at").isNull(), "no_time")
        .when(F.col("nowhere"), "no_coordinates").when((F.col("passed") == 0) & late, "late").otherwise("repeated")
    )
    rejected = counted.withColumn("copies", F.col("came") - F.col("passed")).where("copies > 0")
    return rejected.select(*own, "copies", reason.alias("reason"))


def fleet_stream(
    stream: DataFrame,
    tables: Tables,
    devices: Callable[[], DataFrame],
    folders: Folders,
    checkpoint: str,
    lateness: str = "1 hour",
    key: str = "vehicle_id",
    continuous: bool = True,
    score: Callable[..., DataFrame] = scoring.score_live,
    name: str = "live",
) -> StreamingQuery:
    """The whole live job: deduplicate a feed of vehicles, find their devices, score, alert, store points and routes.

    Writes `anomalies`, `alerts`, `positions`, `daily_routes`, `route_segments` and `rejects`. Every row that came is either
    scored or in `rejects`, with a reason: unknown vehicle, no coordinates, no time, repeated, late, no model. Points
    without a model are stored all the same. A batch that is delivered again changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = store.staged(batch)
        before = store.read_ledger(spark, folders.path("anomalies"), name).where(F.col("batch_id") < batch_id)
        latest = before.select((F.max("newest") - F.expr(f"INTERVAL {lateness}")).alias("latest")).first()["latest"]
        first = batch.where("first").drop("first")
        known = store.staged(by_vehicle(first, devices()) if key == "vehicle_id" else first)
        scored = store.staged(score(valid(known), *tables()))
        own = [key, "recorded_at", "id"]
        strangers = first.join(known.select(*own), own, "left_anti").select(*own, F.lit(1).alias("copies"), F.lit("unknown_vehicle").alias("reason"))
        without = scored.where(F.col("anomaly_score").isNull()).select("device_id", "recorded_at", "id")
        without = known.join(without, ["device_id", "recorded_at", "id"], "left_semi")
        without = without.select(*own, F.lit(1).alias("copies"), F.lit("no_model").alias("reason"))
        _write_batch(outcomes(batch, key, latest).unionByName(strangers).unionByName(without), folders.path("rejects"), batch_id)
        _write_batch(scoring.confirmations(scored).where("should_alert"), folders.path("alerts"), batch_id)
        points = known.select(*[part.split()[0] for part in TABLES["positions"].split(", ")])
        refresh_routes(points, batch_id, folders.path("positions"), folders.path("daily_routes"), folders.path("route_segments"))
        newest = first_time(batch)
        store.append_scores(scoring.as_anomaly_rows(scored), folders.path("anomalies"), name, batch_id, newest)

    return _start(with_first_deliveries(stream, key, lateness), handle, checkpoint, "append", continuous)


def first_time(batch: DataFrame) -> datetime | None:
    """The newest time of the complete rows of a batch: what moves the watermark."""
    complete = batch.where(~F.col("first")).dropna(subset=["recorded_at", "latitude", "longitude"])
    return complete.agg(F.max("recorded_at")).first()[0]


def latest_position_stream(
    stream: DataFrame, out: str, checkpoint: str, continuous: bool = True, fold_every: int = 20
) -> StreamingQuery:
    """Newest position per device, kept up to date: one state row per device, changed devices are written.

    Every `fold_every` batches the view is written as a snapshot, and what it replaces is removed, so a reader meets one
    snapshot and fewer than `fold_every` updates however long the stream runs.
    """
    latest = newest_rows(stream, "device_id")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folded = max(store.batches(spark, f"{out}/snapshots"), default=-1)
        if folded < batch_id:  # else the batch is delivered again after it was folded
            _write_batch(batch, f"{out}/updates", batch_id)
        if (batch_id + 1) % fold_every == 0:
            if folded < batch_id:
                _write_batch(latest_position_view(spark, out, batch_id), f"{out}/snapshots", batch_id)
            store.drop_batches(spark, f"{out}/snapshots", batch_id - 1)
            store.drop_batches(spark, f"{out}/updates", batch_id)

    return _start(latest, handle, checkpoint, "update", continuous)


def latest_position_view(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """Current positions: the newest snapshot (of those up to batch `upto`) and the updates after it."""
    snapshots = [n for n in store.batches(spark, f"{out}/snapshots") if upto is None or n < upto]
    base = max(snapshots, default=-1)
    updates = [n for n in store.batches(spark, f"{out}/updates") if n > base and (upto is None or n <= upto)]
    schema = TABLES["positions"]
    log = spark.createDataFrame([], f"{schema}, batch_id bigint")
    for kind, numbers in (("snapshots", [base] if base >= 0 else []), ("updates", updates)):
        if numbers:
            reader = spark.read.schema(f"{schema}, batch_id bigint").option("basePath", f"{out}/{kind}")
            log = log.unionByName(reader.parquet(*[f"{out}/{kind}/batch_id={n}" for n in numbers]))
    rest = [c for c in log.columns if c not in ("device_id", "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("_row")
    return log.groupBy("device_id").agg(newest).select("device_id", "_row.*")


def refresh_routes(points: DataFrame, batch_id: int, positions_path: str, summary_path: str, segments_path: str) -> None:
    """Store the positions of a batch, then rebuild the routes of the device-days they touch."""
    spark = points.sparkSession
    dated = store.staged(points.withColumns({"date": F.to_date("recorded_at"), "batch_id": F.lit(batch_id)}))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "batch_id").parquet(positions_path)
    touched = dated.select("device_id", "date").distinct()
    stored = spark.read.schema(f"{TABLES['positions']}, date date, batch_id bigint").parquet(positions_path).drop("batch_id")
    stored = store.of_days(stored, touched).join(touched, ["device_id", "date"], "left_semi")
    points = routes.route_points(stored.drop("date"))
    store.save_routes(routes.summarise_routes(points), routes.route_segments(points), summary_path, segments_path)


def route_stream(
    stream: DataFrame, positions_path: str, summary_path: str, segments_path: str, checkpoint: str
) -> StreamingQuery:
    """Incremental refresh: store the new positions, then rebuild the routes of the device-days they touch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        refresh_routes(batch, batch_id, positions_path, summary_path, segments_path)

    return _start(stream, handle, checkpoint, "append", continuous=False)
