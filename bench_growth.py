"""Growth run: the same jobs on copies of the test positions, a third of them under one device.

GROWTH_COPIES (default 10) copies of BENCH_SF_DIR (default sf0.1) are written once to a scratch folder; every
third copy goes to device 0, the others to devices of their own. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waymark import session  # noqa: E402
from waymark.operators.spatial import nearest_zone, points_in_fences  # noqa: E402
from waymark.plans import anomalies, heatmap, routes, scoring, tracking, zones  # noqa: E402
from waymark.sources.fixtures import AS_OF, load  # noqa: E402


def copies(df, count):
    copied = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    own = F.col("device_id") + 10 * (F.col("_copy") + 1)
    moved = {"id": F.col("id") + F.col("_copy") * 10_000_000}
    moved["device_id"] = F.when(F.col("_copy") % 3 == 0, F.lit(0)).otherwise(own)
    for name in ("recorded_at", "detected_at"):
        if name in df.columns:
            moved[name] = F.timestamp_micros(F.unix_micros(name) + F.col("_copy") * 1_000_003)
    return copied.withColumns(moved).drop("_copy")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, count = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("GROWTH_COPIES", "10"))
    scratch = tempfile.mkdtemp(prefix="growth-")
    spark = session.build(
        "growth",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "20g",
            "spark.sql.shuffle.partitions": "64",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": f"{scratch}/checkpoints",
        },
    )
    for name in ("positions", "anomalies"):
        copies(load(spark, sf_dir, name).repartition(32), count).write.parquet(f"{scratch}/{name}")
    positions, scored = spark.read.parquet(f"{scratch}/positions"), spark.read.parquet(f"{scratch}/anomalies")
    routes.route_segments(routes.route_points(positions)).write.parquet(f"{scratch}/segments")
    segments = spark.read.parquet(f"{scratch}/segments")
    zone_table = load(spark, sf_dir, "zones")

    def train():
        models, forests = scoring.train_route_models(segments, AS_OF)
        models.write.mode("overwrite").parquet(f"{scratch}/models")
        forests.write.mode("overwrite").parquet(f"{scratch}/forests")
        return None

    def batch():
        stored = [spark.read.parquet(f"{scratch}/{n}") for n in ("models", "forests")]
        return scoring.score_recent(positions, *stored, AS_OF, hours=24 * 30)

    jobs = {
        "daily_routes": lambda: routes.daily_routes(positions),
        "latest_positions": lambda: tracking.latest_positions(positions),
        "weekly_trend": lambda: anomalies.weekly_trend(scored, AS_OF),
        "anomaly_report": lambda: anomalies.anomaly_report(scored, AS_OF),
        "fleet_heatmap": lambda: heatmap.fleet_heatmap(
            positions,
            load(spark, sf_dir, "device_events"),
            load(spark, sf_dir, "alerts"),
            scored,
            load(spark, sf_dir, "risk_zones"),
            AS_OF,
        ),
        "points_in_geofences": lambda: points_in_fences(positions, load(spark, sf_dir, "geofences")),
        "nearest_zone": lambda: nearest_zone(
            positions.select("id", "device_id", "latitude", "longitude"), zone_table
        ),
        "stop_clusters": lambda: zones.cluster_points(zones.stop_points(segments, scored, AS_OF)),
        "forest_training": train,
        "forest_scoring": batch,
    }
    times = {}
    for name in sys.argv[1:] or jobs:
        start = time.perf_counter()
        result = jobs[name]()
        if result is not None:
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"positions": positions.count(), "copies": count, "unit": "sec", "queries": times}))
    spark.stop()


if __name__ == "__main__":
    main()
