"""Frequent zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.catalog.routes import clean_ctes, haversine_sql
from waymark.plans import routes, zones as Z
from waymark.session import shared_dir
from waymark.sources import store
from waymark.sources.fixtures import AS_OF, load, oracle, portable_sql


def stops(spark, sf):
    segments = routes.route_segments(routes.route_points(load(spark, sf, "positions")))
    return Z.stop_points(segments, load(spark, sf, "anomalies"), AS_OF)


def _stop_points(spark, sf):
    return stops(spark, sf).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


def _clustered(spark, sf):
    return Z.cluster_points(stops(spark, sf)).select("device_id", "recorded_at", "cluster")


def found_zones(spark, sf):
    return Z.summarise_zones(Z.cluster_points(stops(spark, sf)))


def _zones(spark, sf):
    return found_zones(spark, sf).withColumns({c: F.round(c, 6) for c in ("centroid_lat", "centroid_lng")})


def _status(spark, sf):
    shared_dir(spark)
    rows = stops(spark, sf).checkpoint()
    return Z.cluster_status(rows, Z.cluster_points(rows))


def _fleet_status(spark, sf):
    """Every active device, whether it has stop points or not; those of device 4 are taken away."""
    rows = store.staged(stops(spark, sf).where("device_id <> 4"))
    return Z.cluster_status(rows, Z.cluster_points(rows), devices=load(spark, sf, "devices"))


def _list(spark, sf):
    rows = Z.by_density(Z.zone_list(load(spark, sf, "zones")))
    return rows.select(
        "device_id",
        "cluster_id",
        "label",
        F.col("centroid.lat").alias("lat"),
        F.col("centroid.lng").alias("lng"),
        "radius",
        "density",
        "point_count",
    )


QUERIES = {
    "stop_points": _stop_points,
    "stop_clusters": _clustered,
    "frequent_zones": _zones,
    "clustering_status": _status,
    "clustering_status_of_fleet": _fleet_status,
    "zone_list": _list,
    "zone_totals": lambda spark, sf: Z.zone_totals(load(spark, sf, "zones")),
    "zone_heatmap": lambda spark, sf: Z.zone_heatmap(load(spark, sf, "zones")),
}

def clusters_sql(source: str = "positions") -> tuple[str, str]:
    """CTEs up to `stops`, and up to `clustered`, over a table of positions."""
    stops_sql = _STOPS.replace("{clean}", clean_ctes(source))
    return stops_sql, _CLUSTERS.replace("{stops}", stops_sql)


_STOPS = """{clean},
route_days AS (SELECT *, count(*) OVER (PARTITION BY device_id, date) AS n FROM clean),
flagged AS (SELECT DISTINCT device_id, round(latitude, 5) AS lat5, round(longitude, 5) AS lng5 FROM anomalies
  WHERE is_anomaly AND detected_at >= TIMESTAMP '2024-01-11 00:00:00' AND latitude IS NOT NULL),
slow AS (SELECT * FROM route_days WHERE n >= 5 AND date >= DATE '2024-01-11' AND coalesce(speed, 0) <= 10),
stops AS (SELECT device_id, date, hour, recorded_at, latitude, longitude
  FROM slow s ANTI JOIN flagged f
    ON f.device_id = s.device_id AND f.lat5 = round(s.latitude, 5) AND f.lng5 = round(s.longitude, 5)
  QUALIFY row_number() OVER (PARTITION BY device_id, date, hour, round(latitude, 4), round(longitude, 4)
    ORDER BY recorded_at) = 1)"""

# textbook form: all pairs within a device, labels spread over core pairs until they settle
_CLUSTERS = f"""RECURSIVE {{stops}},
usable AS (SELECT * FROM stops QUALIFY count(*) OVER (PARTITION BY device_id) >= 16),
near AS MATERIALIZED (SELECT a.device_id, a.recorded_at AS p, b.recorded_at AS q FROM usable a JOIN usable b
  ON a.device_id = b.device_id AND abs(a.latitude - b.latitude) < 0.002
  WHERE {haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 150),
core AS MATERIALIZED (SELECT device_id, p FROM near GROUP BY device_id, p HAVING count(*) >= 8),
core_pairs AS MATERIALIZED (SELECT n.* FROM near n SEMI JOIN core c ON c.device_id = n.device_id AND c.p = n.p
  SEMI JOIN core d ON d.device_id = n.device_id AND d.p = n.q),
labels(device_id, p, label) USING KEY (device_id, p) AS (
  SELECT device_id, p, p AS label FROM core
  UNION
  SELECT e.device_id, e.q, min(l.label) FROM labels l
  JOIN core_pairs e ON e.device_id = l.device_id AND e.p = l.p
  JOIN recurring.labels r ON r.device_id = e.device_id AND r.p = e.q
  WHERE l.label < r.label GROUP BY e.device_id, e.q),
numbered AS (SELECT device_id, p, dense_rank() OVER (PARTITION BY device_id ORDER BY label) - 1 AS cluster FROM labels),
border AS (SELECT n.device_id, n.p, min(c.cluster) AS cluster FROM near n
  JOIN numbered c ON c.device_id = n.device_id AND c.p = n.q GROUP BY n.device_id, n.p),
clustered AS (SELECT u.*, coalesce(n.cluster, b.cluster, -1) AS cluster FROM usable u
  LEFT JOIN numbered n ON n.device_id = u.device_id AND n.p = u.recorded_at
  LEFT JOIN border b ON b.device_id = u.device_id AND b.p = u.recorded_at)"""

STOPS_SQL, CLUSTERS_SQL = clusters_sql()

CHECKS = {
    "stop_points": portable_sql(
        oracle(
            f"""WITH {STOPS_SQL} SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude)
            FROM stops""",
            "positions",
            "anomalies",
        ),
        "date",
        "recorded_at",
    ),
    "stop_clusters": portable_sql(
        oracle(f"WITH {CLUSTERS_SQL} SELECT device_id, recorded_at, cluster FROM clustered", "positions", "anomalies"),
        "recorded_at",
    ),
    "frequent_zones": oracle(
        f"""WITH {CLUSTERS_SQL},
        centers AS (SELECT device_id, cluster AS cluster_id, avg(latitude) AS centroid_lat,
          avg(longitude) AS centroid_lng, count(*) AS point_count, count(DISTINCT date) AS frequent_days
          FROM clustered WHERE cluster >= 0 GROUP BY device_id, cluster),
        radii AS (SELECT c.device_id, c.cluster AS cluster_id,
          round(max({haversine_sql('c.latitude', 'c.longitude', 'm.centroid_lat', 'm.centroid_lng')}), 1) AS radius
          FROM clustered c JOIN centers m ON m.device_id = c.device_id AND m.cluster_id = c.cluster GROUP BY ALL)
        SELECT device_id, cluster_id, round(centroid_lat, 6) AS centroid_lat, round(centroid_lng, 6) AS centroid_lng,
          point_count, frequent_days, point_count * frequent_days AS ranking_score, radius,
          CAST(point_count AS DOUBLE) AS density,
          CASE WHEN row_number() OVER (PARTITION BY device_id ORDER BY point_count * frequent_days DESC, cluster_id) <= 2
            THEN 'main' ELSE 'secondary' END AS label
        FROM centers JOIN radii USING (device_id, cluster_id)""",
        "positions",
        "anomalies",
    ),
    "clustering_status_of_fleet": oracle(
        f"""WITH {CLUSTERS_SQL}
        SELECT d.id AS device_id, coalesce(s.stop_points, 0) AS stop_points, coalesce(c.n_clusters, 0) AS n_clusters,
          coalesce(c.n_noise, 0) AS n_noise,
          CASE WHEN coalesce(s.stop_points, 0) < 16 THEN 'insufficient_data' ELSE 'ok' END AS status
        FROM devices d
        LEFT JOIN (SELECT device_id, count(*) AS stop_points FROM stops WHERE device_id <> 4 GROUP BY device_id) s ON s.device_id = d.id
        LEFT JOIN (SELECT device_id, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters,
          count(*) FILTER (cluster < 0) AS n_noise FROM clustered WHERE device_id <> 4 GROUP BY device_id) c ON c.device_id = d.id
        WHERE d.status = 'active'""",
        "positions",
        "anomalies",
        "devices",
    ),
    "clustering_status": oracle(
        f"""WITH {CLUSTERS_SQL}
        SELECT s.device_id, s.stop_points, coalesce(c.n_clusters, 0) AS n_clusters, coalesce(c.n_noise, 0) AS n_noise,
          CASE WHEN s.stop_points < 16 THEN 'insufficient_data' ELSE 'ok' END AS status
        FROM (SELECT device_id, count(*) AS stop_points FROM stops GROUP BY device_id) s
        LEFT JOIN (SELECT device_id, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters,
          count(*) FILTER (cluster < 0) AS n_noise FROM clustered GROUP BY device_id) c USING (device_id)""",
        "positions",
        "anomalies",
    ),
    "zone_list": oracle(
        """SELECT device_id, cluster_id, coalesce(label, 'secondary') AS label, centroid_lat AS lat, centroid_lng AS lng,
          radius, density, point_count FROM zones""",
        "zones",
    ),
    "zone_totals": oracle(
        """SELECT device_id, count(*) AS total_clusters, count(*) FILTER (label = 'main') AS main_clusters
        FROM zones GROUP BY device_id""",
        "zones",
    ),
    "zone_heatmap": oracle(
        """SELECT device_id, centroid_lat AS lat, centroid_lng AS lng,
          coalesce(round(coalesce(density, 0) / nullif(max(coalesce(density, 0)) OVER (PARTITION BY device_id), 0), 4), 0)
            AS weight,
          cluster_id, coalesce(label, 'secondary') AS label, radius
        FROM zones WHERE centroid_lat IS NOT NULL AND centroid_lng IS NOT NULL""",
        "zones",
    ),
}
