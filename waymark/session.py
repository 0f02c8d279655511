"""Session settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "waymark", **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; the cluster supplies master and sizes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = ship(prepare(builder.getOrCreate()))
    sweep(spark)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, which need not have it installed."""
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="waymark-")  # workers fetch it from the driver, which removes it at its end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(packed)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on (UTC days) on a session that someone else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`, which the cluster names.

    A local folder is used only where that is unset and the master is local.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="waymark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Folders below the shared one that hold what jobs wrote for themselves.
WORK = ("tables", "llm")


def sweep(spark: SparkSession, older_than_hours: float = 72.0) -> int:
    """Remove intermediate tables that earlier runs left in the shared folder; returns how many.

    Results are lazy and may read them, so a run's own tables stay; give more hours than the longest job takes.
    """
    root, jvm = shared_dir(spark).rstrip("/"), spark._jvm
    limit, removed = (time.time() - older_than_hours * 3600.0) * 1000.0, 0
    for name in WORK:
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.listStatus(folder) if files.exists(folder) else []:
            if found.getModificationTime() < limit and files.delete(found.getPath(), True):
                removed += 1
    return removed


def tabled(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and go on from the table.

    It cuts the lineage as a checkpoint does, but readers take only the columns they need, and Spark knows the size, so
    that it broadcasts a table only if it is small.
    """
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{WORK[0]}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
