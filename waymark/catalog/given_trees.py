"""Scores by forests that a formula gives: trained trees are random, these can be walked by SQL as well.

Every device has the same few trees of two levels, in scaled features; paths, threshold, score, risk and label of all
points are then checked through the same plans that apply trained forests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import settings as S
from waymark.catalog.scoring import CHECKS as SCORING_CHECKS
from waymark.functions.scalars import as_timestamp
from waymark.plans import scoring
from waymark.sources.fixtures import AS_OF, load, oracle

TREES = 9
LIMIT = -0.78
CENTRES = {
    "latitude": (-17.75, 0.05),
    "longitude": (-63.17, 0.02),
    "hour": (12.0, 6.0),
    "speed": (40.0, 35.0),
    "heading": (180.0, 90.0),
    "altitude": (425.0, 15.0),
    "accuracy": (9.0, 4.0),
    "satellites": (8.0, 3.0),
}


def _tree(t: int, width: int) -> tuple[list[int], list[float], list[float]]:
    """Features, cuts and path lengths of the seven slots of tree `t`."""
    features = [t % width, (t + 1) % width, (t + 3) % width, -1, -1, -1, -1]
    cuts = [t / 8 - 0.5, 0.25 - t / 16, t / 32, 0.0, 0.0, 0.0, 0.0]
    paths = [0.0, 0.0, 0.0, 2.0 + t % 3, 3.5, 4.0 + t / 4, 6.0]
    return features, cuts, paths


def given(spark, sf, kind, names):
    """(models, forests) of all devices."""
    devices = load(spark, sf, "positions").select("device_id").distinct()
    means, deviations = zip(*[CENTRES[f] for f in names])
    models = devices.select(
        (F.col("device_id") + 1000).alias("id"),
        "device_id",
        F.lit(kind).alias("model_type"),
        F.to_date(as_timestamp(AS_OF)).alias("trained_to"),
        as_timestamp(AS_OF).alias("created_at"),
        F.array(*map(F.lit, means)).alias("means"),
        F.array(*map(F.lit, deviations)).alias("deviations"),
        F.lit(LIMIT).alias("threshold"),
    )
    trees = [(t, S.TREE_SAMPLE, *_tree(t, len(names))) for t in range(TREES)]
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("tree"),
                F.lit(size).alias("sample_size"),
                F.array(*map(F.lit, features)).alias("feature"),
                F.array(*map(F.lit, cuts)).alias("threshold"),
                F.array(*map(F.lit, paths)).alias("path"),
            )
            for t, size, features, cuts, paths in trees
        ]
    )
    forests = models.select(
        "device_id", F.col("id").alias("model_id"), "trained_to", F.explode(rows).alias("_tree")
    ).select("device_id", "model_id", "trained_to", "_tree.*")
    return models, forests


def _rows(scored):
    return scored.select(
        "id", "device_id", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly",
        F.get_json_object("metadata", "$.risk_level").alias("risk_level"),
        F.get_json_object("metadata", "$.model_id").cast("bigint").alias("model_id"),
    )


def _batch(spark, sf):
    models, forests = given(spark, sf, scoring.ROUTE_MODEL, S.ROUTE_FEATURES)
    return _rows(scoring.score_recent(load(spark, sf, "positions"), models, forests, AS_OF, 24 * 31))


def _sensors(spark, sf):
    models, forests = given(spark, sf, scoring.SENSOR_MODEL, S.SENSOR_FEATURES)
    return _rows(scoring.score_sensors(load(spark, sf, "positions"), models, forests, AS_OF, 31))


def _live(spark, sf):
    models, forests = given(spark, sf, scoring.ROUTE_MODEL, S.ROUTE_FEATURES)
    scored = scoring.score_live(load(spark, sf, "positions"), load(spark, sf, "zones"), models, forests)
    return scored.select(
        "id", "if_score_contrib", "dist_score_contrib", "anomaly_score", "is_anomaly", "risk_level", "min_distance"
    )


QUERIES = {"given_trees_batch": _batch, "given_trees_sensors": _sensors, "given_trees_live": _live}


def _d(number: float) -> str:
    return f"CAST({number!r} AS DOUBLE)"


def decision_sql(names, prefix: str = "") -> str:
    """The decision value of a position, in SQL."""

    def scaled(index: int) -> str:
        name = names[index]
        value = f"hour({prefix}recorded_at)" if name == "hour" else f"{prefix}{name}"
        mean, deviation = map(_d, CENTRES[name])
        return f"((coalesce(CAST({value} AS DOUBLE), 0) - {mean}) / {deviation})"

    def walk(tree, slot: int) -> str:
        features, cuts, paths = tree
        if features[slot] < 0:
            return _d(paths[slot])
        right, left = walk(tree, 2 * slot + 2), walk(tree, 2 * slot + 1)
        return f"CASE WHEN {scaled(features[slot])} > {_d(cuts[slot])} THEN {right} ELSE {left} END"

    depth = " + ".join(f"({walk(_tree(t, len(names)), 0)})" for t in range(TREES))
    n = f"CAST({S.TREE_SAMPLE} AS DOUBLE)"
    norm = f"(2 * (ln({n} - 1) + CAST(0.5772156649015329 AS DOUBLE)) - 2 * ({n} - 1) / {n})"
    return f"(-pow(CAST(2 AS DOUBLE), -(({depth}) / {TREES}) / {norm}) - {_d(LIMIT)})"


_BATCH = f"""WITH decided AS (SELECT id, device_id, {decision_sql(S.ROUTE_FEATURES)} AS decision FROM positions
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL
      AND recorded_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 744 HOUR),
  scored AS (SELECT *, round(least(greatest({_d(0.5)} - decision, 0), 1), 4) AS anomaly_score FROM decided)
  SELECT id, device_id, round(anomaly_score, 9) AS anomaly_score, decision < 0 AS is_anomaly,
    CASE WHEN anomaly_score < {_d(0.4)} THEN 'low' WHEN anomaly_score < {_d(0.65)} THEN 'medium' ELSE 'high' END
      AS risk_level, device_id + 1000 AS model_id
  FROM scored"""
_SENSORS = f"""SELECT id, device_id, round(-{decision_sql(S.SENSOR_FEATURES)}, 9) AS anomaly_score,
    {decision_sql(S.SENSOR_FEATURES)} < 0 AS is_anomaly, CAST(NULL AS VARCHAR) AS risk_level,
    device_id + 1000 AS model_id
  FROM positions WHERE recorded_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 744 HOUR"""

CHECKS = {
    "given_trees_batch": oracle(_BATCH, "positions"),
    "given_trees_sensors": oracle(_SENSORS, "positions"),
    # the additive rule's check, with the label of these trees in place of its own
    "given_trees_live": SCORING_CHECKS["additive_score"]
    .replace("p.speed > 100", f"{decision_sql(S.ROUTE_FEATURES, 'p.')} < 0")
    .replace("p.speed IS NOT NULL AS known", "TRUE AS known"),
}
