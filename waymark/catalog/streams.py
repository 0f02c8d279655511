"""Live jobs, run over the test tables as files that arrive, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.catalog import given_trees
from waymark.catalog import heatmap as heatmap_queries
from waymark.catalog import scoring as scoring_queries
from waymark.catalog import tracking as tracking_queries
from waymark.catalog import routes as route_queries
from waymark.catalog import zones as zone_queries
from waymark.catalog.heatmap import SOURCES
from waymark.catalog.routes import clean_ctes
from waymark.catalog.scoring import segments
from waymark.operators.spatial import nearest_zone
from waymark.plans import heatmap as H
from waymark.plans import refresh, scoring, tracking, zones as Z
from waymark.plans.anomalies import anomaly_report
from waymark.session import shared_dir
from waymark.sources import store
from waymark.sources.fixtures import AS_OF, FORMULAS, load, oracle, portable_sql
from waymark.streaming import live


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The position fixture as a stream of files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    _, columns, _ = FORMULAS["positions"]
    return source.selectExpr(*[f"{text} AS {column}" for column, text in columns])


def _dedupe(spark, sf):
    folder = _folder(spark, "dedupe")
    stream = _stream(spark, sf)
    repeated = stream.unionByName(_stream(spark, sf).withColumn("id", F.col("id") + 1000000000))
    live.write_stream(
        live.without_repeats(repeated), f"{folder}/out", f"{folder}/checkpoint", continuous=False
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("device_id", "recorded_at")


def _latest(spark, sf):
    folder = _folder(spark, "latest")
    live.latest_position_stream(
        _stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint", continuous=False
    ).awaitTermination()
    return live.latest_position_view(spark, f"{folder}/out")


def _by_rule(points, zones, *_):
    """Scores with the stand-in label of the batch check instead of a forest."""
    label = F.when(F.col("speed") > 100.0, -1).otherwise(1)
    rows = points.select("id", "device_id", "recorded_at", "latitude", "longitude", label.alias("label"))
    return scoring.additive_score(nearest_zone(rows, zones).withColumn("model_id", F.lit(1).cast("bigint")))


def _run_scores(spark, sf, out, score, tables):
    folder = _folder(spark, "scores")
    live.score_stream(
        _stream(spark, sf),
        tables,
        f"{folder}/scores",
        f"{folder}/alerts",
        f"{folder}/checkpoint",
        continuous=False,
        score=score,
    ).awaitTermination()
    if out == "scores":
        return store.read_table(spark, f"{folder}/scores", "anomalies")
    return spark.read.parquet(f"{folder}/{out}").drop("batch_id")


def _scores(spark, sf):
    rows = _run_scores(spark, sf, "scores", _by_rule, lambda: (load(spark, sf, "zones"), None, None))
    return rows.select("id", "anomaly_score", "is_anomaly", "detected_at", "metadata")


def _alerts(spark, sf):
    rows = _run_scores(spark, sf, "alerts", _by_rule, lambda: (load(spark, sf, "zones"), None, None))
    return rows.select("id", "should_alert", "risk_level", "anomaly_score")


def _forest_scores(spark, sf):
    models, forests = scoring.train_route_models(segments(spark, sf), AS_OF)
    models = store.staged(models)
    tables = lambda: (load(spark, sf, "zones"), models, forests)
    return _run_scores(spark, sf, "scores", scoring.score_live, tables).drop("metadata", "date")


def _given_trees(spark, sf):
    """The stream itself with forests, trees given by a formula: the same scores as the batch check."""
    models, forests = given_trees.given(spark, sf, scoring.ROUTE_MODEL, S.ROUTE_FEATURES)
    tables = lambda: (load(spark, sf, "zones"), models, forests)
    rows = _run_scores(spark, sf, "scores", scoring.score_live, tables)
    level = F.get_json_object("metadata", "$.risk_level").alias("risk_level")
    return rows.select("id", "anomaly_score", "is_anomaly", level)


def _routes(spark, sf):
    folder = _folder(spark, "routes")
    live.route_stream(
        _stream(spark, sf), f"{folder}/positions", f"{folder}/daily", f"{folder}/segments", f"{folder}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/daily").drop("created_at")


def _route_points(spark, sf):
    """Routes of an open day with their points: half of the devices are stored, the others aggregated and stored on demand."""
    positions = load(spark, sf, "positions")
    target = refresh.Store(_folder(spark, "open-day"))
    refresh.aggregate(positions.where("device_id % 2 = 0"), target, "2024-01-31T00:00:00+00:00", 2)
    for _ in range(2):  # the second time all is stored
        found = refresh.route_of_day(positions, target, "2024-01-30T12:00:00+00:00", "2024-01-30")
    points = found.select("device_id", "date", "total_distance", F.explode("points").alias("p"))
    return points.select(
        "device_id", "date", "total_distance", F.col("p.recorded_at").alias("recorded_at"), F.col("p.latitude").alias("latitude"),
        F.col("p.longitude").alias("longitude"), F.round("p.speed", 6).alias("speed"),
    )


def _route_upsert(spark, sf):
    """Days stored with marked rows first, then replaced by the job where it has data."""
    fresh = store.staged(route_queries.daily_routes(spark, sf))
    folder = _folder(spark, "upsert")
    marked = fresh.withColumn("avg_speed", F.lit(-1.0)).unionByName(
        fresh.withColumns({"device_id": F.col("device_id") + 100, "avg_speed": F.lit(-1.0)})
    )
    store.save_days(marked, folder, "daily_routes")
    store.save_days(fresh, folder, "daily_routes")
    return spark.read.parquet(folder)


def _score_window(spark, sf):
    anomalies = load(spark, sf, "anomalies")
    fresh = anomalies.where("detected_at >= TIMESTAMP '2024-01-30 00:00:00' AND is_anomaly").withColumn(
        "anomaly_score", F.lit(1.0)
    )
    folder = _folder(spark, "window")
    store.save_scores(anomalies, anomalies, folder, AS_OF, 24 * 31)
    store.save_scores(fresh, fresh, folder, AS_OF, 24)
    return store.read_table(spark, folder, "anomalies").drop("date", "metadata")


def _live_and_nightly(spark, sf):
    """One table for live and nightly scores: a stream, its batch delivered twice, the nightly window of half the devices."""
    folder = _folder(spark, "both")
    live.score_stream(
        _stream(spark, sf), lambda: (load(spark, sf, "zones"), None, None), f"{folder}/scores", f"{folder}/alerts",
        f"{folder}/checkpoint", continuous=False, score=_by_rule,
    ).awaitTermination()
    again = store.read_table(spark, f"{folder}/scores", "anomalies").withColumn("anomaly_score", F.lit(9.0))
    assert not store.append_scores(again, f"{folder}/scores", "live", 0)
    positions = load(spark, sf, "positions").where("device_id % 2 = 0 AND recorded_at >= TIMESTAMP '2024-01-30 00:00:00'")
    fresh = positions.where("latitude IS NOT NULL AND id % 3 > 0").select(
        "id", "device_id", "latitude", "longitude", F.lit(0.5).alias("anomaly_score"), F.lit(False).alias("is_anomaly"),
        F.col("recorded_at").alias("detected_at"), F.lit('{"risk_level":"medium"}').alias("metadata"),
    )
    store.save_scores(fresh, positions, f"{folder}/scores", AS_OF, 24)
    return anomaly_report(store.read_table(spark, f"{folder}/scores", "anomalies"), AS_OF, limit=1500)


def _feed(spark, sf):
    """The position fixture as a feed of vehicles: some ids come twice, some vehicles are unknown."""
    devices = load(spark, sf, "devices").select(F.col("id").alias("device_id"), "vehicle_id")
    stream = _stream(spark, sf).join(devices, "device_id")
    unknown = F.when(F.col("id") % 50 == 0, -F.col("vehicle_id")).otherwise(F.col("vehicle_id"))
    return stream.withColumn("vehicle_id", unknown).withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("id") % 10 == 1).cast("int")))).drop("_copy")


def _fleet(spark, sf):
    folders = live.Folders(_folder(spark, "fleet"))
    devices = load(spark, sf, "devices")
    live.fleet_stream(
        _feed(spark, sf), lambda: (load(spark, sf, "zones"), None, None), lambda: devices, folders, folders.path("checkpoint"),
        continuous=False, score=_by_rule,
    ).awaitTermination()
    return folders


def _fleet_outcomes(spark, sf):
    """Rows per vehicle and outcome: all that came are accounted for."""
    folders = _fleet(spark, sf)
    vehicles = load(spark, sf, "devices").select(F.col("id").alias("device_id"), "vehicle_id")
    scored = store.read_table(spark, folders.path("anomalies"), "anomalies").join(vehicles, "device_id")
    scored = scored.select("vehicle_id", F.lit("scored").alias("outcome"), F.lit(1).alias("copies"))
    rejects = spark.read.parquet(folders.path("rejects")).select("vehicle_id", F.col("reason").alias("outcome"), "copies")
    return scored.unionByName(rejects).groupBy("vehicle_id", "outcome").agg(F.sum("copies").alias("rows"))


def _fleet_routes(spark, sf):
    return store.read_table(spark, _fleet(spark, sf).path("daily_routes"), "daily_routes").select(
        "device_id", "date", "point_count", "total_distance"
    )


def _stored_changes(spark, sf, name, feed, key, value, valid):
    """Two feeds stored in turn, the first delivered again after the second, and read with the table."""
    folder = _folder(spark, "changes")
    load(spark, sf, name).write.parquet(f"{folder}/table")
    changes = load(spark, sf, feed)
    halves = [changes.where("id % 2 = 0"), changes.where("id % 2 = 1")]
    for number in (0, 1, 0):
        store.apply_feed(spark, f"{folder}/table", name, halves[number], number, key, value, valid)
    before = store.staged(store.read_changed(spark, f"{folder}/table", name, value).select("id", value))
    store.fold_feeds(spark, f"{folder}/table", name, value)
    after = store.read_changed(spark, f"{folder}/table", name, value).select("id", value)
    return before.exceptAll(after).unionByName(after)


def _stored_modes(spark, sf):
    return _stored_changes(spark, sf, "devices", "modes", "device_id", "modo", tracking._valid_mode())


def _stored_resolutions(spark, sf):
    return _stored_changes(spark, sf, "alerts", "resolutions", "alert_id", "resolved", F.col("resolved"))


def _zone_replace(spark, sf):
    zones = load(spark, sf, "zones").drop("updated_at", "created_at")
    folder = _folder(spark, "zones")
    store.save_zones(zones, zones, folder)
    fresh = zones.where("density IS NULL").withColumn("label", F.lit("new"))
    store.save_zones(fresh, fresh, folder)
    return spark.read.parquet(folder).select("device_id", "cluster_id", "label")


def _heatmap_json(spark, sf):
    folder = _folder(spark, "heatmap")
    cells = H.fleet_heatmap(*[load(spark, sf, name) for name in (*SOURCES, "risk_zones")], AS_OF)
    store.save_heatmap(cells, f"{folder}/lines")
    stored = store.read_heatmap(spark, f"{folder}/lines")
    store.save_heatmap_arrays(stored, f"{folder}/arrays")
    rows = store.read_heatmap(spark, f"{folder}/arrays")
    return rows.withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7)})


def _nightly(spark, sf):
    target = refresh.Store(_folder(spark, "nightly"))
    summary = refresh.refresh(load(spark, sf, "positions"), load(spark, sf, "devices"), target, AS_OF)
    return summary


def _nightly_zones(spark, sf):
    target = refresh.Store(_folder(spark, "nightly"))
    devices = load(spark, sf, "devices")
    refresh.aggregate(load(spark, sf, "positions"), target, AS_OF)
    refresh.refresh_zones(devices, target, AS_OF)
    return Z.zone_totals(spark.read.parquet(target.path("zones")))


QUERIES = {
    "stream_dedupe": _dedupe,
    "stream_latest_positions": _latest,
    "stream_scores": _scores,
    "stream_alerts": _alerts,
    "stream_forest_scores": _forest_scores,
    "stream_given_trees": _given_trees,
    "stream_daily_routes": _routes,
    "route_points_of_open_day": _route_points,
    "route_upsert": _route_upsert,
    "score_window_replace": _score_window,
    "live_and_nightly_report": _live_and_nightly,
    "fleet_stream_outcomes": _fleet_outcomes,
    "fleet_stream_routes": _fleet_routes,
    "stored_mode_changes": _stored_modes,
    "stored_alert_resolutions": _stored_resolutions,
    "zone_replace": _zone_replace,
    "heatmap_json": _heatmap_json,
    "nightly_refresh": _nightly,
    "nightly_points_scored": lambda spark, sf: scoring_queries.points_scored(_nightly(spark, sf)),
    "nightly_zone_totals": _nightly_zones,
}

_RULE = scoring_queries.CHECKS["additive_score"].replace(
    "p.speed IS NOT NULL AS known", "TRUE AS known, p.recorded_at AS detected_at"
).replace("SELECT id, min_distance, CAST", "SELECT id, detected_at, min_distance, CAST")


def active_sql(devices: str) -> str:
    """The CTE `active`: positions before the day of the job, of active devices."""
    return f"""active AS (SELECT * FROM positions
      WHERE device_id IN (SELECT id FROM {devices} WHERE status = 'active'))"""


_CAME = """came AS (SELECT p.*, CASE WHEN p.id % 50 = 0 THEN -d.vehicle_id ELSE d.vehicle_id END AS vehicle_id
    FROM positions p JOIN devices d ON d.id = p.device_id),
  placed AS (SELECT * FROM came WHERE latitude IS NOT NULL AND longitude IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY vehicle_id, recorded_at ORDER BY id) = 1)"""


def _changed_sql(table: str, feed: str, key: str, value: str, valid: str) -> str:
    """Of two halves of a feed the odd ids came later; within a half the newest counts."""
    return oracle(
        f"""WITH newest AS (SELECT {key} AS k, {value} AS v FROM {feed} WHERE {valid}
          QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY id % 2 DESC, changed_at DESC, id DESC) = 1)
        SELECT t.id, CASE WHEN n.k IS NULL THEN t.{value} ELSE n.v END AS {value}
        FROM {table} t LEFT JOIN newest n ON n.k = t.id""",
        table,
        feed,
    )


CHECKS = {
    "live_and_nightly_report": portable_sql(
        oracle(
            f"""WITH rule AS ({_RULE}), live AS (
              SELECT r.id, p.device_id, p.latitude, p.longitude, r.anomaly_score, r.is_anomaly, r.risk_level, r.detected_at
              FROM rule r JOIN positions p USING (id)
              WHERE NOT (p.device_id % 2 = 0 AND p.recorded_at >= TIMESTAMP '2024-01-30 00:00:00')),
            whole AS (SELECT * FROM live UNION ALL
              SELECT id, device_id, latitude, longitude, CAST(0.5 AS DOUBLE), FALSE, 'medium', recorded_at FROM positions
              WHERE device_id % 2 = 0 AND recorded_at >= TIMESTAMP '2024-01-30 00:00:00' AND latitude IS NOT NULL AND id % 3 > 0)
            SELECT * FROM whole WHERE detected_at >= TIMESTAMP '2024-01-24 00:00:00'
            QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY detected_at DESC, id DESC) <= 1500""",
            "positions",
            "zones",
        ),
        "detected_at",
    ),
    "fleet_stream_outcomes": oracle(
        f"""WITH {_CAME},
        labelled AS (SELECT came.vehicle_id,
          CASE WHEN came.latitude IS NULL OR came.longitude IS NULL THEN 'no_coordinates'
            WHEN placed.id IS NULL THEN 'repeated' WHEN came.vehicle_id < 0 THEN 'unknown_vehicle' ELSE 'scored' END AS outcome,
          came.id % 10 = 1 AS twice
          FROM came LEFT JOIN placed USING (id))
        SELECT vehicle_id, outcome, count(*) AS rows FROM (
          SELECT vehicle_id, outcome FROM labelled
          UNION ALL
          SELECT vehicle_id, CASE WHEN outcome IN ('scored', 'unknown_vehicle') THEN 'repeated' ELSE outcome END
          FROM labelled WHERE twice)
        GROUP BY vehicle_id, outcome""",
        "positions",
        "devices",
    ),
    # the means of the same routes fall between two roundings in a few rows, so the routes are compared by their lengths
    "fleet_stream_routes": portable_sql(
        oracle(
            f"""WITH {_CAME}, fed AS (SELECT * FROM placed WHERE vehicle_id > 0), {clean_ctes('fed')},
            routes AS ({route_queries.SUMMARY}) SELECT device_id, date, point_count, total_distance FROM routes""",
            "positions",
            "devices",
        ),
        "date",
    ),
    "route_points_of_open_day": portable_sql(
        oracle(
            f"""WITH {clean_ctes('positions')}, routes AS (SELECT * FROM ({route_queries.SUMMARY}) WHERE date = DATE '2024-01-30')
            SELECT r.device_id, r.date, r.total_distance, c.recorded_at, c.latitude, c.longitude, round(c.speed, 6) AS speed
            FROM routes r JOIN clean c USING (device_id, date)""",
            "positions",
        ),
        "date",
        "recorded_at",
    ),
    "stored_mode_changes": _changed_sql("devices", "modes", "device_id", "modo", "modo IN (0, 1, 2, 3)"),
    "stored_alert_resolutions": _changed_sql("alerts", "resolutions", "alert_id", "resolved", "resolved"),
    # the stream counts a missing speed as 0
    "stream_given_trees": "SELECT id, anomaly_score, is_anomaly, risk_level FROM ("
    + given_trees.CHECKS["given_trees_live"] + ")",
    "stream_dedupe": portable_sql(
        oracle("SELECT DISTINCT device_id, recorded_at FROM positions", "positions"), "recorded_at"
    ),
    "stream_latest_positions": tracking_queries.CHECKS["latest_positions"],
    "stream_scores": portable_sql(
        f"""SELECT id, anomaly_score, is_anomaly, detected_at,
          concat('{{"risk_level":"', risk_level, '","model_id":1}}') AS metadata FROM ({_RULE})""",
        "detected_at",
    ),
    "stream_alerts": f"""SELECT id, is_anomaly AS should_alert, risk_level, anomaly_score FROM ({_RULE})
      WHERE is_anomaly""",
    "stream_daily_routes": route_queries.CHECKS["daily_routes"],
    "route_upsert": f"""WITH fresh AS ({route_queries.CHECKS['daily_routes']})
      SELECT * FROM fresh UNION ALL
      SELECT * REPLACE (device_id + 100 AS device_id, CAST(-1 AS DOUBLE) AS avg_speed) FROM fresh""",
    "score_window_replace": portable_sql(
        oracle(
            """WITH fresh AS (SELECT * REPLACE (CAST(1 AS DOUBLE) AS anomaly_score) FROM anomalies
              WHERE detected_at >= TIMESTAMP '2024-01-30 00:00:00' AND is_anomaly)
            SELECT id, device_id, latitude, longitude, anomaly_score, is_anomaly, detected_at FROM fresh
            UNION ALL
            SELECT id, device_id, latitude, longitude, anomaly_score, is_anomaly, detected_at FROM anomalies
            WHERE detected_at < TIMESTAMP '2024-01-30 00:00:00' OR device_id NOT IN (SELECT device_id FROM fresh)""",
            "anomalies",
        ),
        "detected_at",
    ),
    "zone_replace": oracle(
        """SELECT device_id, cluster_id, 'new' AS label FROM zones WHERE density IS NULL
        UNION ALL
        SELECT device_id, cluster_id, label FROM zones
        WHERE device_id NOT IN (SELECT device_id FROM zones WHERE density IS NULL)""",
        "zones",
    ),
    "heatmap_json": heatmap_queries.CHECKS["fleet_heatmap"],
    "nightly_points_scored": oracle(
        f"""WITH {active_sql("devices")}, {clean_ctes("active")},
        route_days AS (SELECT *, count(*) OVER (PARTITION BY device_id, date) AS n FROM clean),
        trained AS (SELECT device_id FROM route_days WHERE n >= 5 AND date >= DATE '2024-01-11'
          AND date < DATE '2024-01-31' GROUP BY device_id HAVING count(*) >= 50)
        SELECT device_id, count(*) AS points_scored FROM active SEMI JOIN trained USING (device_id)
        WHERE recorded_at >= TIMESTAMP '2024-01-30 00:00:00' AND latitude IS NOT NULL AND longitude IS NOT NULL
        GROUP BY device_id""",
        "positions",
        "devices",
    ),
    # no scores are stored before the zones are built, so no stop is left out as anomalous
    "nightly_zone_totals": oracle(
        f"""WITH RECURSIVE {active_sql("devices")},
        anomalies AS (SELECT CAST(NULL AS BIGINT) AS device_id, CAST(NULL AS DOUBLE) AS latitude,
          CAST(NULL AS DOUBLE) AS longitude, FALSE AS is_anomaly, TIMESTAMP '2024-01-01 00:00:00' AS detected_at),
        {zone_queries.clusters_sql("active")[1].removeprefix("RECURSIVE ")},
        found AS (SELECT device_id, cluster FROM clustered WHERE cluster >= 0 GROUP BY ALL)
        SELECT device_id, count(*) AS total_clusters, least(count(*), 2) AS main_clusters
        FROM found GROUP BY device_id""",
        "positions",
        "devices",
    ),
}
