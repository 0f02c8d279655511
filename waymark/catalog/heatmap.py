"""Hex grid and fleet heatmap."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import hexgrid
from waymark.operators.spatial import hex_cells_of_shapes
from waymark.plans import heatmap as H
from waymark.sources import scans
from waymark.sources.fixtures import AS_OF, load, oracle

SOURCES = ("positions", "device_events", "alerts", "anomalies")


def _sources(spark, sf):
    return H.all_sources(*[load(spark, sf, name) for name in SOURCES], AS_OF)


def _heatmap(spark, sf):
    tables = [load(spark, sf, name) for name in (*SOURCES, "risk_zones")]
    cells = H.fleet_heatmap(*tables, AS_OF)
    return cells.withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7)})


def _source_points(spark, sf):
    return _sources(spark, sf).withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7)})


def _totals(spark, sf):
    return H.cell_totals(_sources(spark, sf)).withColumn("total_weight", F.round("total_weight", 6))


def _positions_hex(spark, sf):
    rows = scans.located(load(spark, sf, "positions"))
    q, r = hexgrid.cell_of(F.col("latitude"), F.col("longitude"))
    rows = rows.select("id", q.alias("q"), r.alias("r"))
    lat, lon = hexgrid.cell_center(F.col("q"), F.col("r"))
    return rows.select(
        "id",
        hexgrid.cell_id(F.col("q"), F.col("r")).alias("cell"),
        F.round(lat, 7).alias("lat"),
        F.round(lon, 7).alias("lon"),
    )


QUERIES = {
    "position_hex_cells": _positions_hex,
    "telemetry_sample": lambda spark, sf: scans.telemetry_sample(load(spark, sf, "positions"), AS_OF).select(
        "id", "latitude", "longitude"
    ),
    "heatmap_sources": _source_points,
    "heatmap_cell_totals": _totals,
    "risk_zone_cells": lambda spark, sf: hex_cells_of_shapes(load(spark, sf, "risk_zones")),
    "fleet_heatmap": _heatmap,
}

_R = "CAST(6371000 AS DOUBLE)"
_S = f"CAST({hexgrid.hex_size()!r} AS DOUBLE)"
_SQRT3 = "sqrt(CAST(3 AS DOUBLE))"


def hex_ctes(source: str, target: str, columns: str) -> str:
    """CTE `target`: `source` (lat, lon and `columns`) with axial cell coordinates q, r."""
    return f"""
{target}_axial AS (SELECT {columns}, ({_SQRT3} / 3 * {_R} * radians(lon) - {_R} * sin(radians(lat)) / 3) / {_S} AS fq,
  (CAST(2 AS DOUBLE) / 3 * {_R} * sin(radians(lat))) / {_S} AS fr FROM {source}),
{target}_cube AS (SELECT *, CAST(floor(fq + 0.5) AS BIGINT) AS q0, CAST(floor(fr + 0.5) AS BIGINT) AS r0,
  CAST(floor(-fq - fr + 0.5) AS BIGINT) AS p0 FROM {target}_axial),
{target}_off AS (SELECT *, abs(q0 - fq) AS dq, abs(r0 - fr) AS dr, abs(p0 + fq + fr) AS dp FROM {target}_cube),
{target} AS (SELECT {columns}, CASE WHEN dq > dp AND dq > dr THEN -p0 - r0 ELSE q0 END AS q,
  CASE WHEN NOT (dq > dp AND dq > dr) AND dr > dp THEN -q0 - p0 ELSE r0 END AS r FROM {target}_off)"""


CENTER = f"""degrees(asin(CAST(1.5 AS DOUBLE) * {_S} * r / {_R})) AS lat,
  degrees({_S} * {_SQRT3} * (q + r / CAST(2 AS DOUBLE)) / {_R}) AS lon"""
_ROUND_CENTER = f"""round(degrees(asin(CAST(1.5 AS DOUBLE) * {_S} * r / {_R})), 7) AS lat,
  round(degrees({_S} * {_SQRT3} * (q + r / CAST(2 AS DOUBLE)) / {_R}), 7) AS lon"""


def _number(first: str, second: str) -> str:
    one = "nullif(TRY_CAST(json_extract_string(metadata, '$.{}') AS DOUBLE), 0)"
    return f"coalesce({one.format(first)}, {one.format(second)})"


_LATLON = f"{_number('latitude', 'lat')} AS lat, {_number('longitude', 'lon')} AS lon"
_SAMPLE = """recorded_at >= TIMESTAMP '2024-01-01 00:00:00' AND abs(speed) < 200 AND id % 20 = 0
  AND latitude IS NOT NULL AND longitude IS NOT NULL"""
_SOURCES = f"""
sources AS (
  SELECT latitude AS lat, longitude AS lon, 'telemetry' AS type, CAST(0.1 AS DOUBLE) AS weight
  FROM positions WHERE {_SAMPLE}
  UNION ALL
  SELECT * FROM (SELECT {_LATLON}, concat('event_', event_type) AS type,
    CAST(CASE WHEN event_type = 'bloqueo' THEN 0.8 ELSE 0.4 END AS DOUBLE) AS weight
    FROM device_events WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00') WHERE lat IS NOT NULL AND lon IS NOT NULL
  UNION ALL
  SELECT latitude, longitude, 'ml_anomaly', anomaly_score FROM anomalies
  WHERE is_anomaly AND detected_at >= TIMESTAMP '2024-01-01 00:00:00' AND latitude <> 0 AND longitude <> 0
  UNION ALL
  SELECT * FROM (SELECT {_LATLON}, concat('alert_', alert_type),
    CAST(CASE WHEN severity = 'high' THEN 0.8 ELSE 0.4 END AS DOUBLE)
    FROM alerts WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00') WHERE lat IS NOT NULL AND lon IS NOT NULL)"""
# brute force: every centre near a square is tested against its box; no scan lines
_ZONE_CELLS = f"""
middles AS (SELECT (lat0 + lat1) / 2 AS lat, (lon0 + lon1) / 2 AS lon, id FROM squares),
{hex_ctes('middles', 'middle_cells', 'id')},
around AS (SELECT m.id, m.q + dq.i AS q, m.r + dr.i AS r FROM middle_cells m,
  (SELECT unnest(range(-6, 7)) AS i) dq, (SELECT unnest(range(-6, 7)) AS i) dr),
centers AS (SELECT id, q, r, {CENTER} FROM around),
zone_cells AS (
  SELECT q, r FROM centers JOIN squares USING (id) WHERE lat > lat0 AND lat < lat1 AND lon > lon0 AND lon < lon1
  UNION SELECT q, r FROM middle_cells)"""
_TOTALS = f"""
{hex_ctes('sources', 'cells', 'type, weight')},
totals AS (SELECT q, r, sum(weight) AS total_weight, count(type) AS event_count FROM cells GROUP BY q, r)"""

CHECKS = {
    "position_hex_cells": oracle(
        f"""WITH points AS (SELECT id, latitude AS lat, longitude AS lon FROM positions WHERE latitude IS NOT NULL),
        {hex_ctes('points', 'cells', 'id')}
        SELECT id, concat('8:', q, ':', r) AS cell, {_ROUND_CENTER} FROM cells""",
        "positions",
    ),
    "telemetry_sample": oracle(f"SELECT id, latitude, longitude FROM positions WHERE {_SAMPLE}", "positions"),
    "heatmap_sources": oracle(
        f"WITH {_SOURCES} SELECT round(lat, 7) AS lat, round(lon, 7) AS lon, type, weight FROM sources", *SOURCES
    ),
    "heatmap_cell_totals": oracle(
        f"WITH {_SOURCES}, {_TOTALS} SELECT q, r, round(total_weight, 6) AS total_weight, event_count FROM totals",
        *SOURCES,
    ),
    "risk_zone_cells": oracle(f"WITH {_ZONE_CELLS} SELECT q, r FROM zone_cells", "squares"),
    "fleet_heatmap": oracle(
        f"""WITH {_SOURCES}, {_ZONE_CELLS},
        {hex_ctes('sources', 'cells', 'type, weight')},
        weighted AS (
          SELECT c.q, c.r, c.type, CASE WHEN z.q IS NULL THEN c.weight ELSE c.weight * 1.5 END AS weight
          FROM cells c LEFT JOIN zone_cells z ON z.q = c.q AND z.r = c.r
          UNION ALL
          SELECT q, r, 'static_risk_zone', CAST(0.5 AS DOUBLE)
          FROM (SELECT q, r FROM zone_cells EXCEPT SELECT q, r FROM cells)),
        totals AS (SELECT q, r, sum(weight) AS w, count(type) AS event_count FROM weighted GROUP BY q, r),
        scaled AS (SELECT *, round(ln(1 + w) / (SELECT max(ln(1 + w)) FROM totals), 4) AS intensity FROM totals)
        SELECT concat('8:', q, ':', r) AS h3_cell, {_ROUND_CENTER}, intensity, event_count
        FROM scaled WHERE intensity > 0.05""",
        *SOURCES,
        "squares",
    ),
}
