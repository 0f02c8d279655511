"""Fences, risk zones near points, nearest frequent zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.catalog.routes import haversine_sql
from waymark.operators import spatial
from waymark.sources.fixtures import load, oracle
from waymark.sources.scans import located


def _points(spark, sf):
    return load(spark, sf, "positions").select("id", "device_id", "latitude", "longitude")


def _in_fences(spark, sf):
    return spatial.points_in_fences(_points(spark, sf), load(spark, sf, "geofences")).select("id", "geofence_id")


def _check_fences(spark, sf):
    # every point asks for one fence; ids 25 to 29 do not exist
    asked = located(_points(spark, sf)).withColumn("geofence_id", F.col("id") % 30)
    return spatial.check_fences(asked, load(spark, sf, "geofences")).select("id", "geofence_id", "inside")


def _near_zones(spark, sf):
    pairs = spatial.zones_near_points(_points(spark, sf), load(spark, sf, "risk_zones"))
    return pairs.select("id", "zone_id", F.round("distance", 3).alias("distance"))


def _nearest(spark, sf):
    return spatial.nearest_zone(_points(spark, sf), load(spark, sf, "zones")).drop("latitude", "longitude")


def _nearest_many(spark, sf):
    """The same with tiny arrays, so that every device takes the merge step."""
    context = spatial.nearest_zone(_points(spark, sf), load(spark, sf, "zones"), per_row=3)
    return context.drop("latitude", "longitude")


def _centroids(spark, sf):
    rows = spatial.centroids(load(spark, sf, "risk_zones"))
    return rows.select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


QUERIES = {
    "points_in_geofences": _in_fences,
    "geofence_check": _check_fences,
    "risk_zones_near_points": _near_zones,
    "nearest_zone": _nearest,
    "nearest_zone_many_blocks": _nearest_many,
    "risk_zone_centroids": _centroids,
}

_INSIDE = "latitude > lat0 AND latitude < lat1 AND longitude > lon0 AND longitude < lon1"
_M = "(CAST(6371000 AS DOUBLE) * radians(CAST(1 AS DOUBLE)))"
_DX = f"greatest(lon0 - longitude, longitude - lon1, 0) * {_M} * cos(radians(latitude))"
_DY = f"greatest(lat0 - latitude, latitude - lat1, 0) * {_M}"
_NEAREST = oracle(
    f"""WITH pairs AS (
      SELECT p.id, z.cluster_id, z.label,
        {haversine_sql('p.latitude', 'p.longitude', 'z.centroid_lat', 'z.centroid_lng')} AS d
      FROM positions p JOIN zones z USING (device_id)
      WHERE z.centroid_lat IS NOT NULL AND z.centroid_lng IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, z.cluster_id) = 1)
    SELECT p.id, p.device_id, n.id IS NOT NULL AS has_clusters, round(n.d, 1) AS min_distance,
      n.cluster_id AS nearest_cluster_id, n.label AS nearest_cluster_label, n.d <= 200 AS inside_cluster
    FROM positions p LEFT JOIN pairs n USING (id)""",
    "positions",
    "zones",
)

CHECKS = {
    "points_in_geofences": oracle(
        f"SELECT p.id, s.id AS geofence_id FROM positions p JOIN squares s ON {_INSIDE}", "positions", "squares"
    ),
    "geofence_check": oracle(
        f"""SELECT p.id, p.id % 30 AS geofence_id, coalesce({_INSIDE}, FALSE) AS inside
        FROM positions p LEFT JOIN squares s ON s.id = p.id % 30 WHERE latitude IS NOT NULL""",
        "positions",
        "squares",
    ),
    "risk_zones_near_points": oracle(
        f"""SELECT * FROM (SELECT p.id, s.id AS zone_id, round(sqrt(pow({_DX}, 2) + pow({_DY}, 2)), 3) AS distance
        FROM positions p, squares s WHERE latitude IS NOT NULL) WHERE distance <= 500""",
        "positions",
        "squares",
    ),
    "nearest_zone": _NEAREST,
    "nearest_zone_many_blocks": _NEAREST,
    "risk_zone_centroids": oracle(
        "SELECT id, round((lat0 + lat1) / 2, 9) AS lat, round((lon0 + lon1) / 2, 9) AS lon FROM squares", "squares"
    ),
}
