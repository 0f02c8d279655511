"""Registered queries, each with the SQL that checks it on the same tables.

Every area module has `QUERIES` (name -> function of session and scale folder) and `CHECKS` (name -> SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.catalog import anomalies, given_trees, heatmap, routes, scoring, spatial, streams, tracking, zones
from waymark.session import prepare
from waymark.sources.fixtures import portable

Query = Callable[[SparkSession, str], DataFrame]
AREAS = (routes, tracking, anomalies, heatmap, spatial, zones, scoring, given_trees, streams)


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(query(prepare(spark), sf_dir))

    return run


def all_queries() -> dict[str, Query]:
    return {name: _ready(query) for area in AREAS for name, query in area.QUERIES.items()}


def all_checks() -> dict[str, str]:
    return {name: text for area in AREAS for name, text in area.CHECKS.items()}
