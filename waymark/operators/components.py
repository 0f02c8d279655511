"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import shared_dir

MAX_ROUNDS = 60


def _state(edges: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Count and checksum of an edge set: one row, whatever its size."""
    digest = F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _star(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest neighbour (or itself) per node `a`, joined back to the node's neighbours `b`."""
    lowest = pairs.groupBy(*keys, "a").agg(F.min(F.least("a", "b")).alias("low"))
    return pairs.join(lowest, [*keys, "a"])


def _large_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    linked = _star(both, keys).where(F.col("b") > F.col("a"))
    return linked.select(*keys, F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    down = edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    starred = _star(down, keys)
    children = starred.select(*keys, F.col("b").alias("a"), F.col("low").alias("b"))
    own = starred.select(*keys, "a", F.col("low").alias("b"))
    return children.unionByName(own).where("a <> b").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label every node with the smallest node of its component, within `keys`.

    `nodes` has keys and `node`; `edges` has keys, `a` and `b`. Rounds grow with the logarithm of a
    component's size; each is checkpointed, so lost executors cost one round at most.
    """
    shared_dir(nodes.sparkSession)
    current = edges.where("a <> b").select(*keys, "a", "b").distinct().checkpoint()
    before = _state(current, keys)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        current = _small_star(_large_star(current, keys), keys).checkpoint()
        after = _state(current, keys)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))
