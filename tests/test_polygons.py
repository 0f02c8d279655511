"""Shapes against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import hexgrid
from waymark.functions.polygons import contains, ring_edges, with_shape
from waymark.operators.spatial import (
    around_the_globe,
    centroids,
    check_fences,
    cover,
    hex_cells_of_shapes,
    levels_in_use,
    points_in_fences,
    zones_near_points,
)


def star(seed, lon, lat, size, corners=11):
    rng = np.random.default_rng(seed)
    angles = np.sort(rng.uniform(0, 2 * np.pi, corners))
    radii = size * rng.uniform(0.3, 1.0, corners)
    ring = [[lon + r * np.cos(a), lat + r * np.sin(a)] for a, r in zip(angles, radii)]
    return [[float(x), float(y)] for x, y in [*ring, ring[0]]]


def square(lon, lat, side):
    return [[lon, lat], [lon + side, lat], [lon + side, lat + side], [lon, lat + side], [lon, lat]]


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": list(rings)})


def multi(*parts):
    return json.dumps({"type": "MultiPolygon", "coordinates": list(parts)})


SHAPES = {
    1: polygon(star(1, -63.1, -17.8, 0.05)),
    2: polygon(square(-63.2, -17.9, 0.2), square(-63.15, -17.85, 0.05)),
    3: multi([square(-63.0, -17.8, 0.03)], [star(5, -62.9, -17.7, 0.04)]),
    4: polygon(square(-63.1, -17.75, 0.0005)),
    5: polygon(star(7, -63.0, -17.8, 6.0)),
}


def even_odd(shape, lat, lon):
    geometry = json.loads(shape)
    rings = geometry["coordinates"]
    if geometry["type"] == "MultiPolygon":
        rings = [ring for part in rings for ring in part]
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [*SHAPES.items(), (90, "not json"), (91, None), (92, '{"type":"Point","coordinates":[1,2]}')]
    return spark.createDataFrame(rows, "id bigint, geojson string")


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(0)
    return [(i, float(a), float(b)) for i, (a, b) in
            enumerate(zip(rng.uniform(-18.0, -17.6, 400), rng.uniform(-63.3, -62.8, 400)))]


def test_points_in_shapes(spark, shapes, grid):
    points = spark.createDataFrame(grid, "id bigint, latitude double, longitude double")
    got = {(r["id"], r["geofence_id"]) for r in points_in_fences(points, shapes).collect()}
    assert got == {(i, s) for i, lat, lon in grid for s, shape in SHAPES.items() if even_odd(shape, lat, lon)}


def test_boundary_is_outside_and_unknown_fence_is_false(spark, shapes):
    asked = [
        (1, 4, -17.7498, -63.0998), (2, 4, -17.75, -63.0998), (3, 4, -17.7495, -63.0995), (4, 77, -17.7498, -63.0998),
        (5, 2, -17.83, -63.13), (6, 2, -17.85, -63.13),
    ]
    requests = spark.createDataFrame(asked, "id bigint, geofence_id bigint, latitude double, longitude double")
    got = {r["id"]: r["inside"] for r in check_fences(requests, shapes).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_hex_cells_fill_shapes(spark, shapes):
    got = {(r["q"], r["r"]) for r in hex_cells_of_shapes(shapes.where("id < 5")).collect()}
    rows, columns = spark.range(90).selectExpr("-17.95d + id * 0.004d as lat"), range(115)
    near = rows.select("lat", F.explode(F.array([F.lit(-63.25 + i * 0.004) for i in columns])).alias("lon"))
    q, r = hexgrid.cell_of(F.col("lat"), F.col("lon"))
    lat, lon = hexgrid.cell_center(F.col("q"), F.col("r"))
    candidates = near.select(q.alias("q"), r.alias("r")).distinct().select("q", "r", lat.alias("lat"), lon.alias("lon"))
    expected = {
        (c["q"], c["r"])
        for c in candidates.collect()
        if any(even_odd(SHAPES[s], c["lat"], c["lon"]) for s in (1, 2, 3, 4))
    }
    middle = centroids(shapes.where("id < 5"))
    q, r = hexgrid.cell_of(F.col("lat"), F.col("lon"))
    expected |= {(c["q"], c["r"]) for c in middle.select(q.alias("q"), r.alias("r")).collect()}
    assert got == expected


def test_centroids(spark, shapes):
    got = {r["id"]: (r["lat"], r["lon"]) for r in centroids(shapes).collect()}
    assert set(got) == set(SHAPES)
    hole, outline = 0.05**2, 0.2**2
    lat = (-17.8 * outline + 17.825 * hole) / (outline - hole)
    assert got[2][0] == pytest.approx(lat, abs=1e-9)
    assert got[4] == pytest.approx((-17.74975, -63.09975), abs=1e-9)


def test_shape_without_area_has_a_centre(spark):
    flat = spark.createDataFrame([(1, polygon([[1.0, 2.0], [3.0, 2.0], [1.0, 2.0]]))], "id bigint, geojson string")
    row = centroids(flat).first()
    assert row["lat"] == 2.0 and 1.0 <= row["lon"] <= 3.0


def test_zones_near_points(spark, shapes):
    points = spark.createDataFrame(
        [(1, -17.7498, -63.0998), (2, -17.7536, -63.0998), (3, -17.76, -63.0998)],
        "id bigint, latitude double, longitude double",
    )
    near = zones_near_points(points, shapes.where("id = 4"), 500.0)
    got = {r["id"]: r["distance"] for r in near.collect()}
    assert got[1] == 0.0 and set(got) == {1, 2}
    assert got[2] == pytest.approx(0.0036 * 111194.93, rel=1e-3)


def test_contains_on_one_row(spark, shapes):
    shape = with_shape(shapes.where("id = 2"))
    row = shape.select(contains(F.col("edges"), F.lit(-17.89), F.lit(-63.19)).alias("in")).first()
    assert row["in"] is True


def test_empty_rings_have_no_edges(spark):
    rings = [([],), ([[0.0, 0.0]],), ([[0.0, 0.0], [0.1, 0.0], [0.0, 0.0]],), (square(0.0, 0.0, 1.0),)]
    got = spark.createDataFrame(rings, "ring array<array<double>>").select(F.size(ring_edges(F.col("ring"))).alias("n"))
    assert sorted(r["n"] for r in got.collect()) == [0, 0, 2, 4]


def frame(spark, places):
    return spark.createDataFrame([(i, lat, lon) for i, (lat, lon) in enumerate(places)], "id bigint, latitude double, longitude double")


def test_zones_on_both_sides_of_the_date_line(spark):
    """Points 100 m to 400 m from a zone's edge, on its own side of 180 degrees and on the other."""
    metre = 180 / (np.pi * 6_371_000.0)
    zones = spark.createDataFrame(
        [(1, polygon(square(179.99, -0.005, 0.01))), (2, polygon(square(-180.0 + 300 * metre, 10.0, 0.01))), (3, polygon(square(179.999, 20.0, 0.002)))],
        "id bigint, geojson string",
    )
    places = [
        (0.0, -180.0 + 167 * metre), (0.0, 180.0), (0.0, -180.0), (0.0, -180.0 + 600 * metre), (0.0, 179.995), (0.0, 179.99 - 400 * metre),
        (10.005, 179.9999), (10.005, 180.0 - 250 * metre), (10.005, -180.0 + 310 * metre), (20.001, -179.9995), (20.001, 179.9995),
    ]
    got = {(r["id"], r["zone_id"]): round(r["distance"]) for r in zones_near_points(frame(spark, places), zones).collect()}
    across = round((300 + 0.0001 / metre) * np.cos(np.radians(10.005)))
    assert got == {(0, 1): 167, (1, 1): 0, (2, 1): 0, (4, 1): 0, (5, 1): 400, (6, 2): across, (8, 2): 0, (9, 3): 0, (10, 3): 0}


def test_fences_past_the_date_line(spark):
    """A ring given beyond 180 degrees holds the places on the other side, and each pair counts once."""
    fences = spark.createDataFrame(
        [(1, polygon(square(179.0, 0.0, 2.0))), (2, polygon(square(-181.0, 0.0, 2.0))), (3, polygon(square(-180.0, -50.0, 360.0)))],
        "id bigint, geojson string",
    )
    places = [(1.0, -179.5), (1.0, 179.5), (1.0, 180.0), (1.0, -180.0), (1.0, 178.9), (1.0, -178.9), (1.0, 0.0), (-60.0, 0.0)]
    got = sorted((r["id"], r["geofence_id"]) for r in points_in_fences(frame(spark, places), fences).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (4, 3), (5, 3), (6, 3)]


def test_zones_near_the_poles(spark):
    """Near a pole all longitudes are close: a pair is found whatever turn lies between, and once."""
    metre = 180 / (np.pi * 6_371_000.0)
    zones = spark.createDataFrame([(1, polygon(square(0.0, 89.99, 0.001))), (2, polygon(square(170.0, -89.995, 0.001)))], "id bigint, geojson string")
    places = [(89.99, -1.0), (89.9905, 359.0 - 360.0), (89.99 - 300 * metre, 0.0005), (89.0, 0.0), (-89.9945, -170.0), (-89.9945, 171.0)]
    pairs = [(r["id"], r["zone_id"]) for r in zones_near_points(frame(spark, places), zones).collect()]
    assert sorted(pairs) == sorted(set(pairs))
    assert {(0, 1), (1, 1), (2, 1), (4, 2), (5, 2)} <= set(pairs) and not any(i == 3 for i, _ in pairs)


@pytest.mark.parametrize("size", [0.001, 0.05, 0.7, 30.0])
def test_cover_accepts_inner_cells(spark, size):
    """Shapes from a few metres to a continent: the pairs are those of a test of all points with all shapes."""
    rng = np.random.default_rng(21)
    rings = {k: star(k, rng.uniform(-size, size), rng.uniform(-size, size), size * rng.uniform(0.3, 1.0), 17) for k in range(6)}
    rings[6] = square(-size, -size, 2 * size)
    made = spark.createDataFrame([(k, polygon(ring)) for k, ring in rings.items()], "id bigint, geojson string")
    places = list(rng.uniform(-2 * size, 2 * size, (1500, 2)))
    got = {(r["id"], r["geofence_id"]) for r in points_in_fences(frame(spark, [tuple(map(float, p)) for p in places]), made).collect()}
    assert got == {(i, k) for i, (lat, lon) in enumerate(places) for k, ring in rings.items() if even_odd(polygon(ring), lat, lon)}
    cells = cover(around_the_globe(with_shape(made)))
    assert cells.where("_inner AND edges IS NOT NULL OR NOT _inner AND edges IS NULL").count() == 0
    assert size < 0.01 or cells.where("_inner").count() > 0
    assert len(levels_in_use(cells)) <= 6 and cells.groupBy("id").count().agg(F.max("count")).first()[0] < 200
