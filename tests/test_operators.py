"""General operators against plain pandas, on data where one key owns most rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.operators.components import connected_components
from waymark.operators.quantiles import exact_quantile
from waymark.operators.ranking import newest_rows, top_k, top_k_early, with_previous
from waymark.operators.spatial import cell_zones, nearest_zone

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 6000
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "key": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n)),
            "t": rng.integers(0, 3000, n),
            "v": np.round(rng.normal(0, 20, n), 2),
        }
    )


def test_top_k(spark, skewed):
    got = top_k(spark.createDataFrame(skewed), ["key"], [F.col("t").desc(), F.col("id")], 25, ["id"]).toPandas()
    ordered = skewed.sort_values(["t", "id"], ascending=[False, True])
    expected = ordered.groupby("key").head(25).assign(rank=lambda d: d.groupby("key").cumcount() + 1)
    merged = got.merge(expected, on=["id", "key", "rank"])
    assert len(merged) == len(got) == len(expected)


@pytest.mark.parametrize("steps", [1, 7, 1000])
@pytest.mark.parametrize("k", [1, 25, 100_000])
def test_top_k_early(spark, skewed, steps, k):
    """The same rows as a plain sort, with null times, whatever the steps; and few rows left to sort."""
    rows = skewed.assign(t=skewed["t"].where(skewed["id"] % 17 > 0))
    df = spark.createDataFrame(rows).withColumn("t", F.when(~F.isnan("t"), F.col("t")))
    got = top_k_early(df, ["key"], [F.col("t").asc_nulls_last(), F.col("id")], k, F.floor(F.col("t") / steps), ["id"]).toPandas()
    expected = rows.sort_values(["t", "id"], na_position="last").groupby("key").head(k)
    expected = expected.assign(rank=expected.groupby("key").cumcount() + 1)
    merged = got.merge(expected, on=["id", "key", "rank"])
    assert len(merged) == len(got) == len(expected)


def test_few_rows_reach_a_large_top_k(spark):
    """Of 200,000 rows of a key about k and one step more are shuffled."""
    rows = spark.range(200_000).selectExpr("id", "id % 2 as key", "timestamp_seconds(id) as t")
    top = top_k_early(rows, ["key"], [F.col("t"), F.col("id")], 2_000, F.date_trunc("minute", "t"), ["id"])
    top.collect()
    plan, widest = [top._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif name in ("ShuffleQueryStage", "ResultQueryStage"):
            plan.append(node.plan())
        else:
            if name == "Exchange":
                widest = max(widest, node.metrics().apply("shuffleRecordsWritten").value())
            plan += [node.children().apply(i) for i in range(node.children().size())]
    assert 4_000 <= widest <= 4_200


@pytest.mark.parametrize("join_back", [False, True])
@pytest.mark.parametrize("text", [False, True])
def test_newest_rows(spark, skewed, text, join_back):
    rows = skewed.assign(t=pd.to_datetime(skewed["t"] // 60, unit="m"))
    rows.loc[rows["id"] % 5 == 0, "v"] = None
    df = spark.createDataFrame(rows)
    if text:
        df = df.withColumn("s", F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id"))))
    found = newest_rows(df, "key", "t", "id", join_back)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == df.columns and ("SortAggregate" in plan) == text
    got = {(r["key"], r["id"], r["v"] if r["v"] == r["v"] else None, r["s"] if text else None) for r in found.collect()}
    expected = rows.sort_values(["t", "id"]).groupby("key").tail(1)
    assert got == {
        (k, i, None if v != v else v, f"s{i}" if text and i % 3 else None)
        for k, i, v in zip(expected["key"], expected["id"], expected["v"])
    }


def test_newest_rows_of_null_times(spark):
    rows = [(1, None, 5), (1, None, 7), (2, None, 1), (2, 3, 0), (3, 4, None)]
    df = spark.createDataFrame(rows, "key long, s long, id long").withColumn("t", F.timestamp_seconds("s")).drop("s")
    assert sorted((r["key"], r["id"]) for r in newest_rows(df, "key", "t").collect()) == [(1, 7), (2, 0), (3, None)]


def test_with_previous(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("slot", F.floor(F.col("t") / 60))
    got = with_previous(df, ["key"], "slot", ["t", "id"], ["id", "v"]).toPandas().set_index("id")
    ordered = skewed.sort_values(["t", "id"])
    expected = ordered.assign(prev=ordered.groupby("key")["id"].shift(), pv=ordered.groupby("key")["v"].shift())
    expected = expected.set_index("id").loc[got.index]
    pd.testing.assert_series_equal(got["prev_id"].astype(float), expected["prev"], check_names=False)
    pd.testing.assert_series_equal(got["prev_v"], expected["pv"], check_names=False)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("width", [0.5, 10.0])
def test_exact_quantile(spark, skewed, q, width):
    got = exact_quantile(spark.createDataFrame(skewed), ["key"], "v", q, "x", width).toPandas().set_index("key")["x"]
    expected = skewed.groupby("key")["v"].quantile(q)
    pd.testing.assert_series_equal(got.sort_index(), expected, check_names=False)


@SLOW
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50)), min_size=1, max_size=30))
def test_exact_median_of_anything(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "key int, v double")
    got = exact_quantile(df, ["key"], "v", 0.5, "m").collect()
    known = [v for v in values if v is not None]
    if not known:
        assert got == []
    else:
        assert got[0]["m"] == pytest.approx(float(np.median(known)), abs=1e-9)


def _roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    nodes = [(d, int(n)) for d in (1, 2) for n in range(120)]
    edges = [(d, int(a), int(b)) for d in (1, 2) for a, b in rng.integers(0, 120, (70, 2))]
    edges += [(1, i, i + 1) for i in range(60, 119)] + [(2, 0, int(i)) for i in range(1, 50)]
    got = connected_components(
        spark.createDataFrame(nodes, "device_id int, node bigint"),
        spark.createDataFrame(edges, "device_id int, a bigint, b bigint"),
        ["device_id"],
    ).collect()
    for device in (1, 2):
        expected = _roots([n for d, n in nodes if d == device], [(a, b) for d, a, b in edges if d == device])
        assert {r["node"]: r["root"] for r in got if r["device_id"] == device} == expected


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([(1, 5)], "device_id int, node bigint")
    edges = spark.createDataFrame([], "device_id int, a bigint, b bigint")
    assert connected_components(nodes, edges, ["device_id"]).first()["root"] == 5


def test_times_are_utc(spark):
    when = dt.datetime(2024, 1, 5, 23, 30, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(when,)], "t timestamp")
    assert str(df.select(F.to_date("t").alias("d")).first()["d"]) == "2024-01-05"


@pytest.mark.parametrize("per_row", [2, 512])
def test_nearest_zone_keeps_every_point(spark, per_row):
    """Equal and NULL ids, missing places, ties, poles and the date line; any split of the zones gives the same."""
    rng = np.random.default_rng(5)
    zones = [(1, i, "z", float(rng.uniform(-1, 1)), float(rng.uniform(-1, 1))) for i in range(60)]
    zones += [(1, 60, "east", 0.0, 179.99), (1, 61, "north", 89.99, 10.0), (1, 62, "twin", 0.0, 179.99)]
    zones += [(2, 7, "only", 5.0, 5.0), (3, 1, "lost", None, 5.0)]
    points = [(i % 3 or None, 1, float(rng.uniform(-1.5, 1.5)), float(rng.uniform(-1.5, 1.5))) for i in range(400)]
    points += [(1, 1, 0.0, -179.99), (1, 1, 89.99, -170.0), (1, 1, None, None), (None, 2, None, 1.0)]
    points += [(5, 2, 0.0, 0.0)] * 3 + [(6, 3, 0.0, 0.0), (7, None, 0.0, 0.0), (8, 2, float("nan"), 0.0)]
    got = nearest_zone(
        spark.createDataFrame(points, "id bigint, device_id bigint, latitude double, longitude double"),
        spark.createDataFrame(
            zones, "device_id bigint, cluster_id int, label string, centroid_lat double, centroid_lng double"
        ),
        per_row=per_row,
    ).collect()
    assert len(got) == len(points)

    def metres(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return 2 * 6_371_000.0 * np.arcsin(np.sqrt(h))

    for row in got:
        mine = [z for z in zones if z[0] == row["device_id"] and z[3] is not None]
        assert row["has_clusters"] == bool(mine)
        if not mine:
            continue
        if row["latitude"] is None or row["longitude"] is None or np.isnan(row["latitude"]):
            assert row["nearest_cluster_id"] == mine[0][1]
            continue
        far = [(round(metres(row["latitude"], row["longitude"], z[3], z[4]), 3), z[1]) for z in mine]
        assert row["nearest_cluster_id"] == min(far)[1]
        assert abs(row["min_distance"] - min(far)[0]) <= 0.06


def test_zone_lists_do_not_grow_with_the_zones_around(spark):
    """Thousands of zones in one 0.02 degree cell, many in one place: short lists, and the same zones as all pairs give."""
    rng = np.random.default_rng(8)
    lat, lng = rng.uniform(0.0, 0.02, 3000), rng.uniform(0.0, 0.02, 3000)
    lat[:500], lng[:500] = 0.012 + rng.uniform(0.0, 1e-3, 500), 0.012 + rng.uniform(0.0, 1e-3, 500)
    lat[2000:], lng[2000:] = 0.005, 0.005  # one place
    ids = rng.permutation(3000)
    at_lat = np.r_[rng.uniform(-0.01, 0.03, 800), 0.012 + rng.uniform(0.0, 1e-3, 800), 60.0]
    at_lng = np.r_[rng.uniform(-0.01, 0.03, 800), 0.012 + rng.uniform(0.0, 1e-3, 800), 20.0]
    zones = pd.DataFrame({"device_id": 1, "cluster_id": ids, "label": "z", "centroid_lat": lat, "centroid_lng": lng})
    points = pd.DataFrame({"id": np.arange(len(at_lat)), "device_id": 1, "latitude": at_lat, "longitude": at_lng})
    zones, points = spark.createDataFrame(zones), spark.createDataFrame(points)

    listed = cell_zones(points, zones)
    cells = listed[0] if isinstance(listed, tuple) else listed
    assert cells.agg(F.max(F.size("zones"))).first()[0] <= 32
    assert cells.groupBy([c for c in cells.columns if c != "zones"]).count().where("count > 1").isEmpty()

    got = nearest_zone(points, zones).orderBy("id").toPandas()
    a, b, c, d = (np.radians(v) for v in (at_lat[:, None], at_lng[:, None], lat[None], lng[None]))
    metres = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))
    nearest = metres.min(axis=1)
    assert np.abs(got["min_distance"] - nearest).max() <= 0.06
    wanted = np.where(metres <= nearest[:, None] + 1e-6, ids[None], 10**9).min(axis=1)
    assert (got["nearest_cluster_id"].to_numpy() == wanted).all()


def test_points_are_not_shuffled_to_few_cells(spark):
    """Nearly all points in one cell: the list is small and broadcast, so that cell is not one task."""
    points = spark.range(50_000).selectExpr("id", "1L AS device_id", "id % 7 * 1e-4 AS latitude", "0.001 AS longitude")
    zones = spark.range(2_000).selectExpr(
        "1L AS device_id", "CAST(id AS INT) AS cluster_id", "'z' AS label", "id * 0.001 AS centroid_lat", "0.0 AS centroid_lng"
    )
    plan = nearest_zone(points, zones)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
