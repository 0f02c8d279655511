"""Anomaly models and scores.

Trained trees are random, so queries that return their scores have no check SQL (a second query returns the columns that
SQL can give): tests check their properties, and `given_trees` checks the same plans with trees given by a formula. The real-time rule is checked with a label derived
from the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import settings as S
from waymark.catalog.routes import clean_ctes, haversine_sql
from waymark.operators.forest import feature_stats
from waymark.operators.quantiles import exact_quantile
from waymark.operators.spatial import nearest_zone
from waymark.plans import routes, scoring
from waymark.plans.anomalies import scoring_summary
from waymark.sources.fixtures import AS_OF, load, oracle


def segments(spark, sf):
    return routes.route_segments(routes.route_points(load(spark, sf, "positions")))


def _route_models(spark, sf):
    return scoring.train_route_models(segments(spark, sf), AS_OF)


def _trained(spark, sf):
    models, _ = _route_models(spark, sf)
    return models.select("device_id", "model_type", "trained_from", "trained_to", "n_samples", "means", "deviations", "threshold")


def _registry(models):
    """What of a model does not depend on random trees."""
    return models.select("device_id", "model_type", "trained_from", "trained_to", "n_samples")


def _tree_sizes(spark, sf):
    _, forests = _route_models(spark, sf)
    inner = F.size(F.filter("feature", lambda f: f >= 0))
    return forests.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("trees"), F.max("sample_size").alias("sample_size"), F.sum(inner).alias("splits")
    )


def _scored(spark, sf):
    models, forests = _route_models(spark, sf)
    return scoring.score_recent(load(spark, sf, "positions"), models, forests, AS_OF)


def _sensor_models(spark, sf):
    models, _ = scoring.train_sensor_models(load(spark, sf, "positions"), AS_OF)
    return models.select("device_id", "model_type", "trained_from", "trained_to", "n_samples", "means", "deviations", "threshold")


def _sensor_scores(spark, sf):
    positions = load(spark, sf, "positions")
    models, forests = scoring.train_sensor_models(positions, AS_OF)
    return scoring.score_sensors(positions, models, forests, AS_OF)


def _live(spark, sf):
    models, forests = _route_models(spark, sf)
    return scoring.score_live(load(spark, sf, "positions"), load(spark, sf, "zones"), models, forests)


def _live_by_rule(spark, sf):
    positions = load(spark, sf, "positions").where("latitude IS NOT NULL")
    # stand-in for the forest: readings above 100 km/h are anomalous, missing ones have no model
    label = F.when(F.col("speed") > 100.0, -1).when(F.col("speed").isNotNull(), 1)
    points = positions.select("id", "device_id", "latitude", "longitude", label.alias("label"))
    scored = scoring.additive_score(nearest_zone(points, load(spark, sf, "zones")))
    return scored.select(
        "id", "if_score_contrib", "dist_score_contrib", "anomaly_score", "is_anomaly", "risk_level", "min_distance"
    )


def _scaling(spark, sf):
    stats = feature_stats(scoring.route_features(segments(spark, sf), AS_OF), S.ROUTE_FEATURES)
    columns = [
        F.round(F.get(kind, F.lit(i)), 6).alias(f"{name}_{kind}")
        for i, name in enumerate(S.ROUTE_FEATURES)
        for kind in ("means", "deviations")
    ]
    return stats.select("device_id", "n_samples", *columns)


def _status(spark, sf):
    rows = scoring.route_features(segments(spark, sf), AS_OF)
    return scoring.training_status(load(spark, sf, "devices"), rows)


def _quantile(spark, sf):
    rows = load(spark, sf, "anomalies")
    result = exact_quantile(rows, ["device_id"], "anomaly_score", S.CONTAMINATION, "threshold", 1e-3)
    return result.withColumn("threshold", F.round("threshold", 9))


def points_scored(summary):
    """What of a summary does not depend on random trees."""
    return summary.select("device_id", "points_scored")


def _summary(spark, sf):
    return scoring_summary(_scored(spark, sf))


QUERIES = {
    "feature_scaling": _scaling,
    "training_status": _status,
    "contamination_threshold": _quantile,
    "route_models": _trained,
    "route_model_registry": lambda spark, sf: _registry(_route_models(spark, sf)[0]),
    "route_forest_sizes": _tree_sizes,
    "route_forest_counts": lambda spark, sf: _tree_sizes(spark, sf).drop("splits"),
    "batch_scores": _scored,
    "batch_score_summary": _summary,
    "batch_points_scored": lambda spark, sf: points_scored(_summary(spark, sf)),
    "sensor_models": _sensor_models,
    "sensor_model_registry": lambda spark, sf: _registry(_sensor_models(spark, sf)),
    "sensor_scores": _sensor_scores,
    "live_scores": _live,
    "additive_score": _live_by_rule,
}

_TRAINING = f"""{clean_ctes('positions')},
route_days AS (SELECT *, count(*) OVER (PARTITION BY device_id, date) AS n FROM clean),
training AS (SELECT device_id, latitude, longitude, CAST(hour AS DOUBLE) AS hour, coalesce(speed, 0) AS speed
  FROM route_days WHERE n >= 5 AND date >= DATE '2024-01-11')"""
_STATS = ", ".join(
    f"round(avg({f}), 6) AS {f}_means, round(CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END, 6)"
    f" AS {f}_deviations"
    for f in S.ROUTE_FEATURES
)

CHECKS = {
    "feature_scaling": oracle(
        f"""WITH {_TRAINING} SELECT device_id, count(*) AS n_samples, {_STATS} FROM training
        GROUP BY device_id HAVING count(*) >= 50""",
        "positions",
    ),
    "training_status": oracle(
        f"""WITH {_TRAINING}
        SELECT d.id AS device_id, count(t.device_id) AS n_samples,
          CASE WHEN count(t.device_id) >= 50 THEN 'TRAINED' ELSE 'SKIPPED' END AS status
        FROM devices d LEFT JOIN training t ON t.device_id = d.id WHERE d.status = 'active' GROUP BY d.id""",
        "positions",
        "devices",
    ),
    "contamination_threshold": oracle(
        "SELECT device_id, round(quantile_cont(anomaly_score, 0.05), 9) AS threshold FROM anomalies GROUP BY device_id",
        "anomalies",
    ),
    # the models' registry rows are not random, only their trees and thresholds are
    "sensor_model_registry": oracle(
        """SELECT device_id, 'SensorForest' AS model_type, '2024-01-01' AS trained_from, '2024-01-31' AS trained_to,
          count(*) AS n_samples
        FROM positions WHERE recorded_at >= TIMESTAMP '2024-01-01 00:00:00'
        GROUP BY device_id HAVING count(*) >= 50""",
        "positions",
    ),
    "route_model_registry": oracle(
        f"""WITH {_TRAINING}
        SELECT device_id, 'IsolationForest' AS model_type, '2024-01-11' AS trained_from, '2024-01-31' AS trained_to,
          count(*) AS n_samples
        FROM training GROUP BY device_id HAVING count(*) >= 50""",
        "positions",
    ),
    "route_forest_counts": oracle(
        f"""WITH {_TRAINING}
        SELECT device_id, 200 AS trees, least(count(*), 256) AS sample_size
        FROM training GROUP BY device_id HAVING count(*) >= 50""",
        "positions",
    ),
    "batch_points_scored": oracle(
        f"""WITH {_TRAINING},
        trained AS (SELECT device_id FROM training GROUP BY device_id HAVING count(*) >= 50)
        SELECT device_id, count(*) AS points_scored FROM positions SEMI JOIN trained USING (device_id)
        WHERE recorded_at >= TIMESTAMP '2024-01-30 00:00:00' AND latitude IS NOT NULL AND longitude IS NOT NULL
        GROUP BY device_id""",
        "positions",
    ),
    "additive_score": oracle(
        f"""WITH nearest AS (
          SELECT p.id, z.label AS zone_label,
            {haversine_sql('p.latitude', 'p.longitude', 'z.centroid_lat', 'z.centroid_lng')} AS d
          FROM positions p JOIN zones z USING (device_id)
          WHERE p.latitude IS NOT NULL AND z.centroid_lat IS NOT NULL AND z.centroid_lng IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, z.cluster_id) = 1),
        parts AS (
          SELECT p.id, p.speed IS NOT NULL AS known, round(n.d, 1) AS min_distance,
            CASE WHEN n.d <= 200 AND n.zone_label = 'main' THEN 0
              WHEN n.d <= 200 AND p.speed > 100 THEN 0.2
              WHEN p.speed > 100 THEN 0.5 ELSE 0 END AS f,
            CASE WHEN round(n.d, 1) > 5000 THEN 0.4 WHEN round(n.d, 1) > 2000 THEN 0.2 ELSE 0 END AS d
          FROM positions p LEFT JOIN nearest n USING (id) WHERE p.latitude IS NOT NULL),
        scored AS (SELECT id, min_distance, CAST(CASE WHEN known THEN f END AS DOUBLE) AS if_score_contrib,
          CAST(CASE WHEN known THEN d END AS DOUBLE) AS dist_score_contrib,
          round(CAST(CASE WHEN known THEN f + d END AS DOUBLE), 2) AS anomaly_score FROM parts)
        SELECT *, coalesce(anomaly_score >= CAST(0.7 AS DOUBLE), FALSE) AS is_anomaly,
          CASE WHEN anomaly_score IS NULL THEN 'unknown' WHEN anomaly_score < CAST(0.4 AS DOUBLE) THEN 'low'
            WHEN anomaly_score < CAST(0.65 AS DOUBLE) THEN 'medium' ELSE 'high' END AS risk_level
        FROM scored""",
        "positions",
        "zones",
    ),
}
