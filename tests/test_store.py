"""Writes, rewrites and live jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from waymark.plans import refresh, scoring, tracking
from waymark.schemas import TABLES
from waymark.sources import store
from waymark.sources.fixtures import AS_OF, load
from waymark.streaming import live

DAY = dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)


def routes(spark, rows):
    return spark.createDataFrame(
        [(d, dt.date(2024, 1, day), n, 1.0, 1.0) for d, day, n in rows],
        "device_id bigint, date date, point_count bigint, total_distance double, avg_speed double",
    )


def test_route_upsert_keeps_untouched_rows(spark, tmp_path):
    path = str(tmp_path / "routes")
    store.save_days(routes(spark, [(1, 5, 10), (2, 5, 20), (1, 6, 30)]), path, "daily_routes")
    store.save_days(routes(spark, [(1, 5, 11)]), path, "daily_routes")
    got = {(r["device_id"], r["date"].day): r["point_count"] for r in spark.read.parquet(path).collect()}
    assert got == {(1, 5): 11, (2, 5): 20, (1, 6): 30}


def test_upserts_read_touched_days_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "routes")
    store.save_days(routes(spark, [(1, day, 10) for day in range(1, 20)]), path, "daily_routes")
    fresh = routes(spark, [(1, 5, 11), (1, 7, 11)])
    for listed in (1000, 1):
        monkeypatch.setattr(store, "LISTED_DAYS", listed)
        touched = store.of_days(spark.read.parquet(path), fresh)
        plan = touched._jdf.queryExecution().toString()
        assert "2024-01-05" in plan.split("PartitionFilters: [")[1].split("]")[0].replace("19727", "2024-01-05")
        assert sorted(r["date"].day for r in touched.collect()) == [5, 7]
    assert store.of_days(spark.read.parquet(path), fresh.limit(0)).count() == 0


def scored(spark, rows):
    return spark.createDataFrame(
        [(i, d, 1.0, 1.0, 0.5, False, DAY + dt.timedelta(hours=h), None) for i, d, h in rows], TABLES["anomalies"]
    )


def test_score_window_is_replaced_and_emptied_days_vanish(spark, tmp_path):
    path = str(tmp_path / "scores")
    first = scored(spark, [(1, 1, -30), (2, 1, -2), (3, 1, 2), (4, 2, -2)])
    store.save_scores(first, first, path, "2024-01-31T00:00:00+00:00", 24 * 9)
    fresh = scored(spark, [(9, 1, 3)])
    processed = spark.createDataFrame([(1,), (2,)], "device_id bigint")
    store.save_scores(fresh, processed, path, "2024-01-31T00:00:00+00:00", 48)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 9]
    assert not (tmp_path / "scores" / "date=2024-01-29").exists()


def test_a_batch_of_scores_counts_once(spark, tmp_path):
    """Delivered again before and after it was noted, and after the nightly job has folded it."""
    path = str(tmp_path / "scores")
    read = lambda: sorted((r["id"], r["anomaly_score"]) for r in store.read_table(spark, path, "anomalies").collect())
    nightly = scored(spark, [(1, 1, 2), (2, 2, 3)])
    store.save_scores(nightly, nightly, path, "2024-01-31T00:00:00+00:00", 24)
    first = scored(spark, [(10, 1, 4), (11, 2, 5), (12, 1, 30)])
    assert store.append_scores(first, path, "live", 0)
    whole = read()
    assert [i for i, _ in whole] == [1, 2, 10, 11, 12]
    changed = first.withColumn("anomaly_score", F.lit(0.9))
    assert not store.append_scores(changed, path, "live", 0) and read() == whole
    assert store.append_scores(scored(spark, [(13, 1, 6)]), path, "live", 1)
    assert store.append_scores(scored(spark, [(14, 2, 7)]), path, "other", 1)
    # not noted yet: the folders of the batch are written anew
    store._drop_folders(spark, [f"{path}/_ledger/stream=other/batch_id=1"])
    assert store.append_scores(scored(spark, [(14, 2, 7)]), path, "other", 1)
    assert [i for i, _ in read()] == [1, 2, 10, 11, 12, 13, 14]
    # the nightly job replaces device 1 from day 30 on and folds what is live
    fresh = scored(spark, [(20, 1, 8)])
    store.save_scores(fresh, fresh, path, "2024-01-31T00:00:00+00:00", 24)
    assert [i for i, _ in read()] == [2, 11, 14, 20]
    assert sorted(p.name for p in tmp_path.glob("scores/date=*/batch=*")) == ["batch=nightly"]
    assert not store.append_scores(first, path, "live", 0) and [i for i, _ in read()] == [2, 11, 14, 20]


def test_an_interrupted_fold_is_repaired(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "scores")
    assert store.append_scores(scored(spark, [(1, 1, 2), (2, 2, 3)]), path, "live", 0)
    fresh = scored(spark, [(5, 1, 4)])

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_drop_folders", lost)
        with pytest.raises(RuntimeError):
            store.save_scores(fresh, fresh, path, "2024-01-31T00:00:00+00:00", 24)
    store.save_scores(fresh, fresh, path, "2024-01-31T00:00:00+00:00", 24)
    assert sorted(r["id"] for r in store.read_table(spark, path, "anomalies").collect()) == [2, 5]


def test_stored_types_are_the_declared_ones(spark, tmp_path):
    path = str(tmp_path / "scores")
    nulls = scored(spark, [(1, 1, 2)]).withColumn("anomaly_score", F.lit(None).cast("double"))
    nulls.withColumn("date", F.lit("2024-01-30")).withColumn("batch", F.lit("7")).drop("metadata").write.partitionBy("date", "batch").parquet(path)
    got = store.read_table(spark, path, "anomalies")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][-2:] == [("metadata", "string"), ("date", "date")]
    assert got.where("metadata IS NULL AND anomaly_score IS NULL").count() == 1
    assert store.read_table(spark, str(tmp_path / "none"), "forests").count() == 0


def test_feeds_count_in_their_order(spark, tmp_path):
    """Two feeds, the first again after the second, then folded; rejected rows are told."""
    path = str(tmp_path / "devices")
    devices = spark.createDataFrame(
        [(i, f"imei{i}", i, "active", DAY, DAY, None, 0) for i in range(1, 5)], TABLES["devices"]
    )
    devices.write.parquet(path)
    feed = lambda rows: spark.createDataFrame(
        [(i, d, m, DAY + dt.timedelta(minutes=t)) for i, d, m, t in rows], "id bigint, device_id bigint, modo int, changed_at timestamp"
    )
    feeds = [feed([(1, 1, 2, 0), (2, 2, 1, 0), (3, 2, 3, 5), (4, 9, 1, 0)]), feed([(5, 1, 1, 1), (6, 3, 8, 1)])]
    valid = tracking._valid_mode()
    rejected = {}
    for number in (0, 1, 0):
        found = store.apply_feed(spark, path, "devices", feeds[number], number, "device_id", "modo", valid)
        rejected[number] = sorted((r["id"], r["reason"]) for r in found.collect())
    assert rejected == {0: [(4, "unknown_key")], 1: [(6, "invalid_value")]}
    modes = lambda: {r["id"]: r["modo"] for r in store.read_changed(spark, path, "devices", "modo").collect()}
    assert modes() == {1: 1, 2: 3, 3: 0, 4: 0}
    store.fold_feeds(spark, path, "devices", "modo")
    assert modes() == {1: 1, 2: 3, 3: 0, 4: 0} and not (tmp_path / "devices_changes" / "modo").exists()
    store.apply_feed(spark, path, "devices", feed([(7, 2, 0, 9)]), 2, "device_id", "modo", valid)
    assert modes() == {1: 1, 2: 0, 3: 0, 4: 0}


def test_zones_of_unprocessed_devices_stay(spark, tmp_path):
    path = str(tmp_path / "zones")
    schema = (
        "device_id bigint, cluster_id int, centroid_lat double, centroid_lng double, density double, radius double, "
        "point_count bigint, label string, frequent_days bigint, ranking_score bigint"
    )
    rows = [(1, 0, 1.0, 1.0, 5.0, 3.0, 5, "main", 1, 5), (2, 0, 1.0, 1.0, 5.0, 3.0, 5, "main", 1, 5)]
    zones = spark.createDataFrame(rows, schema)
    store.save_zones(zones, zones, path)
    store.save_zones(zones.where("false"), zones.where("device_id = 1"), path)
    stored = spark.read.parquet(path)
    assert [r["device_id"] for r in stored.collect()] == [2]
    assert "ranking_score" not in stored.columns


def test_heatmap_as_one_array(spark, tmp_path):
    cells = [{"h3_cell": f"8:{i}:0", "lat": 1.0, "lon": 2.0, "intensity": 0.5, "event_count": i} for i in range(3)]
    (tmp_path / "heatmap.json").write_text(json.dumps(cells, indent=1))
    got = store.read_heatmap(spark, str(tmp_path / "heatmap.json"), whole_file=True)
    assert sorted(r["event_count"] for r in got.collect()) == [0, 1, 2]


def test_heatmap_arrays_hold_every_cell(spark, tmp_path):
    cells = spark.range(200).selectExpr(
        "concat('8:', id * 7, ':', id - 100) as h3_cell", "1.0d as lat", "2.0d as lon", "0.5d as intensity",
        "id as event_count",
    )
    store.save_heatmap_arrays(cells, str(tmp_path / "arrays"))
    got = store.read_heatmap(spark, str(tmp_path / "arrays"))
    assert sorted(r["event_count"] for r in got.collect()) == list(range(200))


def test_nightly_job_and_live_scores(spark, sf_dir, tmp_path):
    """Stored tables feed the live job; a batch of the same points gives the same scores."""
    positions, devices = load(spark, sf_dir, "positions"), load(spark, sf_dir, "devices")
    target = refresh.Store(str(tmp_path / "store"))
    assert refresh.refresh(positions, devices, target, AS_OF, steps=["aggregate", "train"], trees=20) is None
    summary = refresh.refresh(positions, devices, target, AS_OF, steps=["infer"], hours=24 * 20)
    assert sum(r["points_scored"] for r in summary.collect()) == spark.read.parquet(target.path("anomalies")).count()
    status = refresh.refresh_zones(devices, target, AS_OF)
    assert {r["status"] for r in status.collect()} <= {"ok", "insufficient_data"}

    models, forests = spark.read.parquet(target.path("models")), spark.read.parquet(target.path("forests"))
    zones = store.read_table(spark, target.path("zones"), "zones")
    arrivals = str(tmp_path / "arrivals")
    positions.where("id % 2 = 0").coalesce(1).write.mode("append").parquet(arrivals)
    tables = lambda: (zones, models, forests)
    folders = [str(tmp_path / name) for name in ("scores", "alerts", "checkpoint")]
    for _ in range(2):
        live.score_stream(live.position_stream(spark, arrivals, 1), tables, *folders, continuous=False).awaitTermination()
        positions.where("id % 2 = 1").coalesce(1).write.mode("append").parquet(arrivals)
    live_rows = {r["id"]: r["anomaly_score"] for r in store.read_table(spark, folders[0], "anomalies").collect()}
    batch = scoring.score_live(live.valid(positions), zones, models, forests)
    expected = {r["id"]: r["anomaly_score"] for r in scoring.as_anomaly_rows(batch).collect()}
    assert live_rows == expected and len(expected) > 0


def test_refresh_reaches_inactive_devices_on_request(spark, sf_dir, tmp_path):
    positions, devices = load(spark, sf_dir, "positions"), load(spark, sf_dir, "devices")
    seen = {}
    for flag in (False, True):
        target = refresh.Store(str(tmp_path / f"store-{flag}"))
        refresh.refresh(positions, devices, target, AS_OF, steps=["aggregate"], days=30, include_inactive=flag)
        rows = spark.read.parquet(target.path("daily_routes")).select("device_id").distinct().collect()
        seen[flag] = {r["device_id"] for r in rows}
    assert seen[True] - seen[False] <= {3, 7} and {3, 7} & seen[False] == set()


def _arrive(spark, folder, rows):
    data = [(i, 1, DAY + dt.timedelta(minutes=m), 1.0, 1.0, 1.0, None, None, None, None, None) for i, m in rows]
    spark.createDataFrame(data, TABLES["positions"]).coalesce(1).write.mode("append").parquet(folder)


def test_repeats_and_late_rows_are_dropped(spark, tmp_path):
    arrivals, out, checkpoint = [str(tmp_path / n) for n in ("in", "out", "checkpoint")]
    dropped = 0
    for rows in ([(1, 0), (2, 5)], [(3, 5), (4, 300)], [(5, 301)], [(6, 1)], [(7, 302)]):
        _arrive(spark, arrivals, rows)
        stream = live.without_repeats(live.position_stream(spark, arrivals), "10 minutes")
        query = live.write_stream(stream, out, checkpoint, continuous=False)
        query.awaitTermination()
        for progress in query.recentProgress:
            dropped += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4, 5, 7]
    assert dropped == 1


def test_latest_position_follows_the_stream(spark, tmp_path):
    arrivals, out, checkpoint = [str(tmp_path / n) for n in ("in", "out", "checkpoint")]
    for rows, newest in (([(1, 0), (2, 5)], 2), ([(3, 3)], 2), ([(4, 9)], 4)):
        _arrive(spark, arrivals, rows)
        live.latest_position_stream(
            live.position_stream(spark, arrivals), out, checkpoint, continuous=False
        ).awaitTermination()
        assert [r["id"] for r in live.latest_position_view(spark, out).collect()] == [newest]


def test_latest_positions_stay_bounded(spark, tmp_path, monkeypatch):
    """After 100 batches a reader meets one snapshot and fewer updates than a fold takes."""
    out, schema = str(tmp_path / "out"), TABLES["positions"]
    handle = {}

    class Writer:
        def __getattr__(self, name):
            return lambda *args, **_: (handle.update(f=args[0]) if name == "foreachBatch" else None, self)[1]

    class Stream:
        writeStream = Writer()

    monkeypatch.setattr(live, "newest_rows", lambda stream, key: stream)
    live.latest_position_stream(Stream(), out, str(tmp_path / "checkpoint"), fold_every=10)
    newest = {}
    for n in range(100):
        rows = [(n * 2 + d, d, DAY + dt.timedelta(minutes=n), 1.0, 1.0, 1.0, None, None, None, None, None) for d in (n % 3, n % 7)]
        newest.update({r[1]: r[0] for r in rows})
        handle["f"](spark.createDataFrame(rows, schema).dropDuplicates(["device_id"]), n)
        if n in (4, 9, 55, 94):
            view = live.latest_position_view(spark, out)
            assert set(view.toPandas()["device_id"]) == set(newest)
    assert {r["device_id"]: r["id"] // 2 for r in live.latest_position_view(spark, out).collect()} == {d: i // 2 for d, i in newest.items()}
    assert store.batches(spark, f"{out}/snapshots") == [99] and store.batches(spark, f"{out}/updates") == []
    handle["f"](spark.createDataFrame([], schema), 99)  # delivered again
    assert {r["device_id"] for r in live.latest_position_view(spark, out).collect()} == set(newest)


def test_every_row_of_a_feed_is_accounted_for(spark, tmp_path):
    """Unknown vehicles, missing places and times, repeats within and across batches, late rows and rows without a model."""
    schema = TABLES["positions"].replace("device_id bigint", "vehicle_id bigint")
    arrivals, folders = str(tmp_path / "in"), live.Folders(str(tmp_path / "store"))
    devices = spark.createDataFrame([(5, 70), (4, 70), (6, 71)], "id bigint, vehicle_id bigint")
    at = lambda m: None if m is None else DAY + dt.timedelta(minutes=m)

    def score(points, *_):
        label = F.when(F.col("device_id") == 6, F.lit(None)).otherwise(F.when(F.col("speed") > 100, -1).otherwise(1))
        rows = points.withColumns({"label": label.cast("int"), "inside_cluster": F.lit(False), "model_id": F.lit(1).cast("bigint")})
        rows = rows.withColumns({"nearest_cluster_label": F.lit("main"), "min_distance": F.lit(9000.0)})
        return scoring.additive_score(rows)

    def arrive(rows):
        data = [(i, v, at(m), lat, 1.0, speed, None, None, None, None, None) for i, v, m, lat, speed in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        live.fleet_stream(
            stream, lambda: (None, None, None), lambda: devices, folders, folders.path("checkpoint"), "10 minutes", continuous=False,
            score=score,
        ).awaitTermination()

    arrive([(1, 70, 0, 1.0, 120.0), (1, 70, 0, 1.0, 120.0), (2, 70, 0, 1.0, 9.0), (3, 71, 1, 1.0, 9.0), (4, 99, 1, 1.0, 9.0), (5, 70, 2, None, 9.0)])
    arrive([(6, 70, 0, 1.0, 9.0), (7, 70, 60, 1.0, 9.0), (8, None, 3, 1.0, 9.0), (9, 70, None, 1.0, 9.0)])
    arrive([(10, 70, 5, 1.0, 9.0), (11, 70, 61, 1.0, 130.0)])
    rejects = spark.read.parquet(folders.path("rejects")).collect()
    found = sorted((r["id"], r["copies"], r["reason"]) for r in rejects)
    one, two = [r for r in found if r[0] in (1, 2)], [r for r in found if r[0] not in (1, 2)]
    assert sum(copies for _, copies, _ in one) == 2 and {reason for *_, reason in one} == {"repeated"}
    assert two == [
        (3, 1, "no_model"), (4, 1, "unknown_vehicle"), (5, 1, "no_coordinates"), (6, 1, "repeated"), (8, 1, "unknown_vehicle"),
        (9, 1, "no_time"), (10, 1, "late"),
    ]
    stored = {r["id"]: r["device_id"] for r in store.read_table(spark, folders.path("anomalies"), "anomalies").collect()}
    assert len(stored) == 3 and {7, 11} < set(stored) and set(stored.values()) == {4}
    assert len(stored) + sum(copies for _, copies, _ in found) == 12
    alerts = {r["id"] for r in spark.read.parquet(folders.path("alerts")).collect()}
    assert alerts <= {1, 11} and 11 in alerts
    positions = spark.read.parquet(folders.path("positions")).collect()
    assert len(positions) == 4 and {r["device_id"] for r in positions} == {4, 6}


def test_vehicle_resolution(spark):
    devices = spark.createDataFrame([(5, 70), (4, 70), (6, 71)], "id bigint, vehicle_id bigint")
    points = spark.createDataFrame([(1, 70), (2, 99)], "id bigint, vehicle_id bigint").withColumn(
        "device_id", F.lit(0)
    )
    got = live.by_vehicle(points, devices).collect()
    assert [(r["id"], r["device_id"]) for r in got] == [(1, 4)]
    unknown = tracking.unknown_vehicles(points, devices).collect()
    assert [r["vehicle_id"] for r in unknown] == [99]


def test_streamed_routes_equal_batch_routes(spark, sf_dir, tmp_path):
    from waymark.plans import routes as R

    positions = load(spark, sf_dir, "positions")
    arrivals, folders = str(tmp_path / "in"), [str(tmp_path / n) for n in ("positions", "daily", "segments", "check")]
    for part in (0, 1):
        positions.where(f"id % 2 = {part}").coalesce(1).write.mode("append").parquet(arrivals)
        live.route_stream(live.position_stream(spark, arrivals), *folders).awaitTermination()
    got = spark.read.parquet(folders[1]).select("device_id", "date", "point_count", "total_distance", "avg_speed")
    expected = R.daily_routes(positions).select(*got.columns)
    assert expected.exceptAll(got).count() == 0 and got.count() == expected.count()


def test_shared_folder_is_demanded_on_clusters(spark, monkeypatch):
    from waymark import session

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError):
        session.shared_dir(Fake())


def test_repeated_training_leaves_one_forest_per_model(spark, sf_dir, tmp_path):
    """A second run with the same `as_of` on other data replaces models and scores; other days' models stay."""
    positions, devices = load(spark, sf_dir, "positions"), load(spark, sf_dir, "devices")
    target = refresh.Store(str(tmp_path / "store"))
    earlier = "2024-01-25T00:00:00+00:00"
    for as_of, rows in ((earlier, positions), (AS_OF, positions), (AS_OF, positions.where("id % 10 < 9"))):
        refresh.refresh(rows, devices, target, as_of, trees=10)
    models, forests = spark.read.parquet(target.path("models")), spark.read.parquet(target.path("forests"))
    assert models.groupBy("id").count().where("count > 1").count() == 0
    assert {r["count"] for r in forests.groupBy("model_id").count().collect()} == {10}
    assert models.select("trained_to").distinct().count() == 2
    _, trees = scoring.current(models, forests, scoring.ROUTE_MODEL)
    assert "PartitionFilters: [isnotnull(trained_to" in trees._jdf.queryExecution().toString()


def test_scoring_before_any_training(spark, sf_dir, tmp_path):
    """No model, no table: the job scores nothing and stores nothing, and the live job stores no score."""
    target = refresh.Store(str(tmp_path / "store"))
    positions, devices = load(spark, sf_dir, "positions"), load(spark, sf_dir, "devices")
    assert refresh.refresh(positions, devices, target, AS_OF, steps=["infer"]).count() == 0
    models, forests = (
        store.read_table(spark, target.path(path), name) for path, name in (("models", "trained_models"), ("forests", "forests"))
    )
    zones = store.read_table(spark, target.path("zones"), "zones")
    scored_live = scoring.score_live(live.valid(positions), zones, models, forests)
    assert scored_live.where("anomaly_score IS NOT NULL").count() == 0 and scored_live.count() > 0
    assert {r["risk_level"] for r in scored_live.select("risk_level").distinct().collect()} == {"unknown"}


def test_sweep_removes_old_tables_only(spark, tmp_path, monkeypatch):
    import os

    from waymark import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    old, new = session.tabled(spark.range(3)), session.tabled(spark.range(4))
    (tmp_path / "other").mkdir()
    first, second = (next(iter(df.inputFiles())).split("/tables/")[1].split("/")[0] for df in (old, new))
    for folder in (tmp_path / "tables" / first, tmp_path / "other"):
        os.utime(folder, (1, 1))
    assert session.sweep(spark) == 1
    assert [p.name for p in (tmp_path / "tables").iterdir()] == [second] and (tmp_path / "other").exists() and new.count() == 4
