"""DBSCAN against a brute-force version: labels, not just counts."""

import numpy as np
import pandas as pd
import pytest

from waymark.operators import clustering
from waymark.operators.clustering import dbscan
from waymark.plans import zones

R = 6_371_000.0


def brute_force(lat, lon, eps, min_samples):
    """All pairs; clusters grow from core points in input order."""
    phi, lam = np.radians(lat), np.radians(lon)
    a = np.sin((phi[:, None] - phi) / 2) ** 2 + np.cos(phi[:, None]) * np.cos(phi) * np.sin((lam[:, None] - lam) / 2) ** 2
    near = 2 * R * np.arcsin(np.sqrt(np.minimum(a, 1))) <= eps
    core = near.sum(axis=1) >= min_samples
    labels = np.full(len(lat), -1)
    cluster = 0
    for start in range(len(lat)):
        if not core[start] or labels[start] >= 0:
            continue
        labels[start], queue = cluster, [start]
        while queue:
            point = queue.pop()
            if not core[point]:
                continue
            for other in np.flatnonzero(near[point] & (labels < 0)):
                labels[other] = cluster
                queue.append(other)
        cluster += 1
    return labels


def compare(spark, lat, lon, eps=150.0, min_samples=8, device=1):
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    frame = pd.DataFrame({"device_id": device, "point": np.arange(len(lat)), "latitude": lat, "longitude": lon})
    got = dbscan(spark.createDataFrame(frame), eps, min_samples).toPandas().sort_values("point")
    assert len(got) == len(lat)
    expected = brute_force(lat, lon, eps, min_samples)
    np.testing.assert_array_equal(got["cluster"].to_numpy(), expected)
    return expected


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("spread", [0.004, 0.012, 0.03])
def test_scattered(spark, seed, spread):
    rng = np.random.default_rng(seed)
    labels = compare(spark, -17.7 + rng.uniform(0, spread, 500), -63.1 + rng.uniform(0, spread, 500))
    assert spread > 0.02 or labels.max() >= 0


@pytest.mark.parametrize("latitude", [0.0, 59.9, -75.0])
def test_dense_places_with_bridges(spark, latitude):
    rng = np.random.default_rng(4)
    degree = 111_000 * np.cos(np.radians(latitude))
    centres = [(0, 0), (140, 0), (400, 0), (400, 250), (900, 900)]
    x = np.concatenate([c[0] + rng.normal(0, 25, 80) for c in centres] + [np.linspace(0, 900, 20)])
    y = np.concatenate([c[1] + rng.normal(0, 25, 80) for c in centres] + [np.linspace(0, 900, 20)])
    order = rng.permutation(len(x))
    compare(spark, latitude + y[order] / 111_000, 30 + x[order] / degree)


def test_dense_cells_just_out_of_reach(spark):
    rng = np.random.default_rng(8)
    for gap in (148.0, 152.0):
        x = np.concatenate([rng.uniform(-60, 0, 40), gap + rng.uniform(0, 60, 40), [0.0, gap]])
        y = np.concatenate([rng.uniform(-1, 1, 80), [0.0, 0.0]])
        labels = compare(spark, y / 111_194.9, x / 111_194.9)
        assert labels.max() == (0 if gap < 150 else 1)


@pytest.mark.parametrize("gap", [149.99999, 150.00001])
def test_full_cells_that_barely_touch(spark, gap):
    """Two full cells whose facing sides are arcs about each other: thousands of points, nearly all at just about 150 m."""
    rng = np.random.default_rng(12)
    angle = rng.uniform(-0.3, 0.3, 1500)
    east = np.stack([gap * np.cos(angle), gap * np.sin(angle)]) + np.stack([rng.exponential(5.0, 1500), np.zeros(1500)])
    east[:, :200] = gap * np.stack([np.cos(angle[:200]), np.sin(angle[:200])])
    west = np.stack([-rng.exponential(5.0, 1500), rng.normal(0, 0.001, 1500)])
    west[:, 0] = 0.0
    x, y = np.concatenate([west, east], axis=1) / 111_194.9266
    expected = brute_force(y, x, 150.0, 8)
    frame = pd.DataFrame({"device_id": 1, "point": np.arange(3000), "latitude": y, "longitude": x})
    got = dbscan(spark.createDataFrame(frame)).toPandas().sort_values("point")
    np.testing.assert_array_equal(got["cluster"].to_numpy(), expected)
    assert expected.max() == (0 if gap < 150 else 1)


def test_a_full_cell_needs_no_pairs_of_points(spark):
    """20,000 points in each of two cells out of reach: the parts that are compared are few."""
    rng = np.random.default_rng(13)
    y = rng.uniform(0, 90, 40_000)
    x = np.where(np.arange(40_000) < 20_000, rng.uniform(0, 90, 40_000), rng.uniform(241, 330, 40_000))
    frame = pd.DataFrame({"device_id": 1, "point": np.arange(40_000), "latitude": y / 111_194.9, "longitude": x / 111_194.9})
    points = clustering.with_cell(spark.createDataFrame(frame), 150.0)
    sizes = points.groupBy("device_id", "cell").count().withColumnRenamed("count", "size")
    points = points.join(sizes, ["device_id", "cell"])
    kept = []
    table, clustering.tabled = clustering.tabled, lambda df: kept.append(table(df)) or kept[-1]
    try:
        assert {(r["a"] > 0, r["b"] > 0) for r in clustering._dense_edges(points, 150.0, 8).collect()} <= {(True, True)}
    finally:
        clustering.tabled = table
    assert max(df.count() for df in kept[1:]) < 4_000  # the first one holds the points themselves


def test_across_the_date_line(spark):
    rng = np.random.default_rng(9)
    lon = 180 + rng.normal(0, 0.0006, 120)
    labels = compare(spark, -17 + rng.normal(0, 0.0006, 120), np.where(lon > 180, lon - 360, lon))
    assert labels.max() == 0


def test_border_point_joins_the_first_cluster(spark):
    # two groups of eight, 296 m apart; the point between reaches two points of each
    west, east = np.linspace(-8, 0, 8), 296 + np.linspace(0, 8, 8)
    x = np.concatenate([[148.0], east, west])
    labels = compare(spark, np.zeros(len(x)), x / 111_194.9)
    assert labels[0] == 0 and labels[1] == 0 and labels[-1] == 1


def test_devices_do_not_mix(spark):
    rng = np.random.default_rng(11)
    frames = []
    for device in (1, 2, 3):
        n = 20 * device
        frames.append(
            pd.DataFrame(
                {
                    "device_id": device,
                    "point": np.arange(n),
                    "latitude": -17.7 + rng.normal(0, 0.002, n),
                    "longitude": -63.1 + rng.normal(0, 0.002, n),
                }
            )
        )
    got = dbscan(spark.createDataFrame(pd.concat(frames))).toPandas()
    for frame in frames:
        own = got[got["device_id"] == frame["device_id"].iloc[0]].sort_values("point")
        expected = brute_force(frame["latitude"].to_numpy(), frame["longitude"].to_numpy(), 150.0, 8)
        np.testing.assert_array_equal(own["cluster"].to_numpy(), expected)


def test_main_zones_on_ties(spark):
    rows = []
    for cluster, count in ((0, 3), (1, 5), (2, 3)):
        rows += [(1, cluster, "2024-01-05", -17.0 - cluster, -63.0)] * count
    frame = spark.createDataFrame(rows, "device_id bigint, cluster int, date string, latitude double, longitude double")
    got = zones.summarise_zones(frame).collect()
    assert {r["cluster_id"]: r["label"] for r in got} == {0: "main", 1: "main", 2: "secondary"}
    assert {r["cluster_id"]: r["radius"] for r in got} == {0: 0.0, 1: 0.0, 2: 0.0}
