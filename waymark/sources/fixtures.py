"""Fleet tables derived from the test tables (`events`, `nation`, `supplier`).

One formula text per column serves both Spark SQL and the checking database, so both sides start
from the same input rows. Decimal literals are cast, or Spark would compute in DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import prepare

AS_OF = "2024-01-31T00:00:00+00:00"
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _d(number: str) -> str:
    return f"CAST({number} AS DOUBLE)"


_STILL = "event_type IN ('click', 'view', 'signup')"
_SITE = f"floor(hour(ts) / {_d('8')})"
_LAT = f"""CASE WHEN event_id % 53 = 0 THEN NULL
  WHEN {_STILL} THEN {_d('-17.78')} + (user_id % 10) * {_d('0.01')} + {_SITE} * {_d('0.009')}
    + ((event_id * 7919) % 101 - 50) * {_d('0.000008')}
    + CASE WHEN event_id % 97 = 0 THEN {_d('0.5')} ELSE {_d('0')} END
  ELSE {_d('-17.78')} + (user_id % 10) * {_d('0.01')} + ((event_id * 104729) % 1001 - 500) * {_d('0.00003')}
    + CASE WHEN event_id % 97 = 0 THEN {_d('0.5')} ELSE {_d('0')} END END"""
_LON = f"""CASE WHEN event_id % 53 = 0 THEN NULL
  WHEN {_STILL} THEN {_d('-63.18')} + {_SITE} * {_d('0.007')} + ((event_id * 6271) % 101 - 50) * {_d('0.000008')}
  ELSE {_d('-63.18')} + ((event_id * 15485863) % 1001 - 500) * {_d('0.00003')} END"""
_GAP = "event_id % 17 = 0"
_SCORE = f"round((value % {_d('100')}) / {_d('100')}, 4)"
_RISK = f"""CASE WHEN {_SCORE} < {_d('0.4')} THEN 'low' WHEN {_SCORE} < {_d('0.65')} THEN 'medium' ELSE 'high' END"""
_LOCATION = f"""concat('{{', CASE WHEN event_id % 2 = 0 THEN '"latitude":' ELSE '"lat":' END,
  CASE WHEN event_id % 19 = 0 THEN '0' ELSE CAST(-17780 + (event_id * 7919) % 101 AS VARCHAR(20)) END, 'e-3,',
  CASE WHEN event_id % 2 = 0 THEN '"longitude":' ELSE '"lon":' END,
  CAST(-63180 + (event_id * 6271) % 101 AS VARCHAR(20)), 'e-3}}')"""

_LAT0 = f"({_d('-17.80')} + (n_nationkey % 5) * {_d('0.03')})"
_LON0 = f"({_d('-63.21')} + floor(n_nationkey / {_d('5')}) * {_d('0.02')})"
_SIDE = f"({_d('0.002')} + (n_nationkey % 4) * {_d('0.006')})"
_SQUARE = f"""concat('{{"type":"Polygon","coordinates":[[[', {_LON0}, ',', {_LAT0}, '],[', {_LON0} + {_SIDE}, ',', {_LAT0},
  '],[', {_LON0} + {_SIDE}, ',', {_LAT0} + {_SIDE}, '],[', {_LON0}, ',', {_LAT0} + {_SIDE}, '],[', {_LON0}, ',', {_LAT0}, ']]]}}')"""

_POSITION = [
    ("id", "event_id"),
    ("device_id", "user_id % 10"),
    ("recorded_at", "CAST(ts AS TIMESTAMP)"),
    ("latitude", _LAT),
    ("longitude", _LON),
    ("speed", f"CASE WHEN event_id % 13 = 0 THEN NULL WHEN {_STILL} THEN value % {_d('10')} ELSE value END"),
    ("heading", f"CASE WHEN {_GAP} THEN NULL ELSE CAST((event_id * 37) % 360 AS DOUBLE) END"),
    ("altitude", f"CASE WHEN {_GAP} THEN NULL ELSE CAST(400 + event_id % 50 AS DOUBLE) END"),
    ("accuracy", f"CASE WHEN {_GAP} THEN NULL ELSE CAST(3 + event_id % 12 AS DOUBLE) END"),
    ("satellites", f"CASE WHEN {_GAP} THEN NULL ELSE CAST(4 + event_id % 9 AS INT) END"),
    ("metadata", "props"),
]

# name -> (source table, [(column, expression)], filter)
FORMULAS: dict[str, tuple[str, list[tuple[str, str]], str]] = {
    "positions": ("events", _POSITION, ""),
    "device_events": (
        "events",
        [
            ("id", "event_id"),
            ("device_id", "user_id % 10"),
            ("event_type", "CASE WHEN event_id % 3 = 0 THEN 'bloqueo' ELSE 'ignition_on' END"),
            ("position_id", "event_id"),
            ("created_at", "CAST(ts AS TIMESTAMP)"),
            ("metadata", _LOCATION),
        ],
        "event_type = 'error'",
    ),
    "alerts": (
        "events",
        [
            ("id", "event_id"),
            ("device_id", "user_id % 10"),
            ("alert_type", "CASE WHEN event_id % 7 = 0 THEN 'geofence' ELSE 'speeding' END"),
            (
                "severity",
                f"CASE WHEN value < {_d('50')} THEN 'low' WHEN value < {_d('100')} THEN 'medium' "
                f"WHEN value < {_d('200')} THEN 'high' ELSE 'critical' END",
            ),
            ("metadata", f"CASE WHEN event_id % 29 = 0 THEN NULL ELSE {_LOCATION} END"),
            ("created_at", "CAST(ts AS TIMESTAMP)"),
            ("resolved", "event_id % 2 = 0"),
        ],
        "event_type = 'purchase'",
    ),
    "anomalies": (
        "events",
        [
            ("id", "event_id"),
            ("device_id", "user_id % 10"),
            ("latitude", _LAT),
            ("longitude", _LON),
            ("anomaly_score", _SCORE),
            ("is_anomaly", f"{_SCORE} >= {_d('0.7')}"),
            ("detected_at", "CAST(ts AS TIMESTAMP)"),
            (
                "metadata",
                f"""CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '{{"model_id":1}}'
                ELSE concat('{{"risk_level":"', {_RISK}, '","model_id":1}}') END""",
            ),
        ],
        "",
    ),
    "models": (
        "events",
        [
            ("id", "event_id"),
            ("device_id", "user_id % 10"),
            ("model_type", "CASE WHEN event_id % 2 = 0 THEN 'IsolationForest' ELSE 'SensorForest' END"),
            ("trained_from", "CAST(ts AS DATE) - 20"),
            ("trained_to", "CAST(ts AS DATE)"),
            ("created_at", "CAST(ts AS TIMESTAMP)"),
        ],
        "event_type = 'click'",
    ),
    "modes": (
        "events",
        [
            ("id", "event_id"),
            ("device_id", "user_id % 10"),
            ("modo", "CAST(event_id % 5 AS INT)"),
            ("changed_at", "CAST(ts AS TIMESTAMP)"),
        ],
        "event_type = 'signup'",
    ),
    "resolutions": (
        "events",
        [("id", "event_id"), ("alert_id", "event_id"), ("resolved", "TRUE"), ("changed_at", "CAST(ts AS TIMESTAMP)")],
        f"value > {_d('100')}",
    ),
    "zones": (
        "supplier",
        [
            ("device_id", "s_suppkey % 10"),
            ("cluster_id", "CAST(floor(s_suppkey / CAST(10 AS DOUBLE)) AS INT)"),
            (
                "centroid_lat",
                f"CASE WHEN s_suppkey % 31 = 30 THEN NULL ELSE {_d('-17.78')} + (s_suppkey % 10) * {_d('0.01')} "
                f"+ ((s_suppkey * 7919) % 101 - 50) * {_d('0.0016')} END",
            ),
            (
                "centroid_lng",
                f"CASE WHEN s_suppkey % 31 = 30 THEN NULL ELSE {_d('-63.18')} "
                f"+ ((s_suppkey * 6271) % 101 - 50) * {_d('0.0016')} END",
            ),
            ("density", "CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE floor(abs(s_acctbal)) END"),
            ("radius", "CAST(50 + s_nationkey AS DOUBLE)"),
            ("point_count", "CAST(floor(abs(s_acctbal)) AS BIGINT)"),
            (
                "label",
                "CASE WHEN s_suppkey % 13 = 12 THEN NULL WHEN s_suppkey < 20 THEN 'main' ELSE 'secondary' END",
            ),
            ("updated_at", "TIMESTAMP '2024-01-30 02:00:00'"),
            ("created_at", "TIMESTAMP '2024-01-30 02:00:00'"),
        ],
        "",
    ),
    "geofences": (
        "nation",
        [
            ("id", "CAST(n_nationkey AS BIGINT)"),
            ("vehicle_id", "CAST(1000 + n_nationkey % 10 AS BIGINT)"),
            ("name", "n_name"),
            ("geojson", _SQUARE),
            ("active", "n_nationkey % 6 <> 5"),
            ("type", "CASE WHEN n_nationkey % 2 = 0 THEN 'include' ELSE 'exclude' END"),
            ("created_at", "TIMESTAMP '2024-01-01 00:00:00'"),
            ("updated_at", "TIMESTAMP '2024-01-01 00:00:00'"),
        ],
        "",
    ),
    "risk_zones": (
        "nation",
        [
            ("id", "CAST(n_nationkey AS BIGINT)"),
            ("name", "n_name"),
            ("geojson", _SQUARE),
            ("risk_level", f"(n_nationkey % 11) / {_d('10')}"),
            ("created_at", "TIMESTAMP '2024-01-01 00:00:00'"),
        ],
        "",
    ),
    # corners of the same squares, for checks that need numbers rather than GeoJSON
    "squares": (
        "nation",
        [
            ("id", "CAST(n_nationkey AS BIGINT)"),
            ("vehicle_id", "CAST(1000 + n_nationkey % 10 AS BIGINT)"),
            ("lat0", _LAT0),
            ("lon0", _LON0),
            ("lat1", f"{_LAT0} + {_SIDE}"),
            ("lon1", f"{_LON0} + {_SIDE}"),
        ],
        "",
    ),
}

# queries that need more than one projection of one table
VIEWS: dict[str, str] = {
    "positions_dup": """
        SELECT * FROM positions
        UNION ALL
        SELECT id + 1000000000 AS id, device_id, recorded_at, latitude, longitude, speed + 1 AS speed,
          heading, altitude, accuracy, satellites, metadata
        FROM positions WHERE id % 41 = 0""",
    "devices": """
        SELECT user_id % 10 AS id, concat('imei-', CAST(user_id % 10 AS VARCHAR(20))) AS device_imei,
          1000 + user_id % 10 AS vehicle_id,
          CASE WHEN user_id % 10 % 4 = 3 THEN 'inactive' ELSE 'active' END AS status,
          CAST(min(ts) AS TIMESTAMP) AS activated_at, CAST(max(ts) AS TIMESTAMP) AS last_seen,
          CAST(NULL AS VARCHAR(20)) AS metadata, CAST(user_id % 10 % 4 AS INT) AS modo
        FROM events GROUP BY user_id % 10""",
}


def _formula_sql(name: str, source: str) -> str:
    _, columns, condition = FORMULAS[name]
    picked = ",\n  ".join(f"{text} AS {column}" for column, text in columns)
    where = f"\nWHERE {condition}" if condition else ""
    return f"SELECT {picked}\nFROM {source}{where}"


def oracle(body: str, *names: str) -> str:
    """Check SQL: the named fixture tables as CTEs, then `body` (which may start with more CTEs)."""
    needed = list(names)
    if "positions_dup" in needed and "positions" not in needed:
        needed.insert(0, "positions")
    needed.sort(key=lambda n: n in VIEWS)
    ctes = []
    for name in needed:
        text = VIEWS[name] if name in VIEWS else _formula_sql(name, FORMULAS[name][0])
        ctes.append(f"{name} AS (\n{text}\n)")
    head = "WITH " + ",\n".join(ctes)
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


def portable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that two engines' results compare by value."""
    formats = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    return df.select(
        *[F.date_format(name, formats[kind]).alias(name) if kind in formats else F.col(name) for name, kind in df.dtypes]
    )


def portable_sql(text: str, *columns: str) -> str:
    """The same for check SQL: `*_at` columns are timestamps, the other named ones dates."""
    replaced = [
        f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" if c.endswith("_at") else f"CAST({c} AS VARCHAR) AS {c}"
        for c in columns
    ]
    return f"SELECT * REPLACE ({', '.join(replaced)}) FROM (\n{text}\n)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table, derived by Spark from the parquet tables of one scale."""
    prepare(spark)
    if name == "positions_dup":
        return spark.sql(VIEWS[name].replace("FROM positions", "FROM {base}"), base=load(spark, sf_dir, "positions"))
    if name == "devices":
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        return spark.sql(VIEWS[name].replace("FROM events", "FROM {base}"), base=events)
    source, columns, condition = FORMULAS[name]
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if condition:
        table = table.where(condition)
    return table.selectExpr(*[f"{text} AS {column}" for column, text in columns])
