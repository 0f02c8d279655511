"""Isolation forests (Liu, Ting and Zhou 2008), one per device.

Every tree has a sample of its own, 256 of all the rows of its device, so growing takes bounded memory whatever the
device's history. A forest is a table with one row per tree: a complete binary tree in three arrays,
children of slot i in slots 2i+1 and 2i+2.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import settings as S
from waymark.operators.quantiles import exact_quantile
from waymark.session import tabled

TREE_SCHEMA = (
    "device_id bigint, tree int, sample_size int, feature array<int>, threshold array<double>, path array<double>"
)


#: Trees of a device that one call grows.
TREES_PER_GROUP = 20


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree over n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    big = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def grow_forest(samples: np.ndarray, seeds: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """Grow one tree per sample, level by level; every level is a few array operations over all trees.

    `samples` is [tree, row, feature]. A tree depends on its own sample and seed alone.
    """
    trees, sample, width = samples.shape
    depth = max(1, math.ceil(math.log2(max(sample, 2))))
    slots = 2 ** (depth + 1) - 1
    values = samples.reshape(-1, width)
    tree = np.repeat(np.arange(trees), sample)
    draws = np.stack([np.random.default_rng(list(seed)).random((2, slots)) for seed in seeds])
    which, where = draws[:, 0], draws[:, 1]
    feature = np.full((trees, slots), -1, dtype=np.int32)
    threshold = np.zeros((trees, slots))
    path = np.zeros((trees, slots))
    slot = np.zeros(len(tree), dtype=np.int64)
    live = np.ones(len(tree), dtype=bool)

    for level in range(depth + 1):
        active = np.flatnonzero(live)
        if len(active) == 0:
            break
        key = tree[active] * slots + slot[active]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        node_tree, node_slot = np.divmod(key[starts], slots)
        low = np.minimum.reduceat(values[active], starts, axis=0)
        high = np.maximum.reduceat(values[active], starts, axis=0)
        varies = high > low
        options = varies.sum(axis=1)
        leaf = (options == 0) | (sizes <= 1) | (level == depth)
        path[node_tree[leaf], node_slot[leaf]] = level + mean_path(sizes[leaf])
        # a random one of the features that vary, and a random cut within its range
        pick = np.minimum((which[node_tree, node_slot] * options).astype(int), np.maximum(options - 1, 0))
        column = np.argmax(np.cumsum(varies, axis=1) == (pick + 1)[:, None], axis=1)
        span = np.arange(len(starts))
        cut = low[span, column] + where[node_tree, node_slot] * (high[span, column] - low[span, column])
        split = ~leaf
        feature[node_tree[split], node_slot[split]] = column[split]
        threshold[node_tree[split], node_slot[split]] = cut[split]
        node_of = np.repeat(span, sizes)
        right = values[active, column[node_of]] > cut[node_of]
        slot[active] = 2 * slot[active] + 1 + right
        live[active] = split[node_of]
    return {"feature": feature, "threshold": threshold, "path": path, "sample": np.full(trees, sample)}


def mean_depth(rows: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees.

    Leaves are pushed down to the last level (an endless threshold always leads left), so all rows walk the
    same number of levels without a test for leaves. One tree at a time stays in the processor's cache.
    """
    trees, slots = feature.shape
    levels = int(math.log2(slots + 1)) - 1
    feature, threshold, path = feature.astype(np.intp), threshold.copy(), path.copy()
    steps = []
    for level in range(levels):
        at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        leaf = feature[:, at] < 0
        threshold[:, at] = np.where(leaf, np.inf, threshold[:, at])
        path[:, 2 * at + 1] = np.where(leaf, path[:, at], path[:, 2 * at + 1])
        steps.append((np.where(leaf, 0, feature[:, at]), threshold[:, at]))
    bottom = path[:, 2**levels - 1 :]
    result = np.zeros(len(rows))
    block = 8192
    for start in range(0, len(rows), block):
        values = np.ascontiguousarray(rows[start : start + block].T)
        count = values.shape[1]
        flat, line, total = values.ravel(), np.arange(count), np.zeros(count)
        for tree in range(trees):
            at = np.zeros(count, dtype=np.intp)
            for column, cut in steps:
                value = flat.take(column[tree].take(at) * count + line)
                at = 2 * at + (value > cut[tree].take(at))
            total += bottom[tree].take(at)
        result[start : start + block] = total / trees
    return result


def filled(points: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features are 0 for a model."""
    return points.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def feature_stats(points: DataFrame, features: Sequence[str], min_rows: int = S.MIN_TRAINING_ROWS) -> DataFrame:
    """Rows, means and population deviations per device (1 where a feature does not vary)."""
    means = [F.avg(f) for f in features]
    deviations = [F.when(F.stddev_pop(f) > 0.0, F.stddev_pop(f)).otherwise(F.lit(1.0)) for f in features]
    return (
        points.groupBy("device_id")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.array(*means).alias("means"),
            F.array(*deviations).alias("deviations"),
        )
        .where(F.col("n_samples") >= min_rows)
    )


def scaled(features: Sequence[str]) -> list[Column]:
    """Standardised features z0, z1, ..., given the columns `means` and `deviations`."""
    return [
        ((F.col(f) - F.get("means", F.lit(i))) / F.get("deviations", F.lit(i))).alias(f"z{i}")
        for i, f in enumerate(features)
    ]


def _uniform(*parts: Column) -> Column:
    """A hash of the parts as a number above 0 and below 1."""
    return (F.xxhash64(*parts).cast("double") + F.lit(2.0**63) + F.lit(0.5)) / F.lit(2.0**64)


def tree_samples(
    points: DataFrame, counts: DataFrame, key: str, trees: int, seed: int, wider: float = 1.5, short: DataFrame | None = None
) -> DataFrame:
    """Candidates of every tree's sample: the rows of `points`, once per tree they may be in, with `tree` and `draw`.

    A row is in a tree with probability wider * 256 / count of its device, each tree on its own. The first tree of a row
    is drawn from one hash, as the length of a run of failures; most rows of a large device fail at all trees and go
    before anything else is computed. So no row is shuffled, and what is left grows with the trees, not with the rows.
    `short` (device_id, tree) asks for these trees only.
    """
    share = F.least(F.lit(1.0), F.lit(wider * S.TREE_SAMPLE) / F.col("n_samples"))
    identity = [F.lit(seed), F.lit(wider), F.col("device_id"), F.col(key)]
    first = F.when(F.col("_share") >= 1.0, 0).otherwise(F.floor(F.log(_uniform(*identity)) / F.log1p(-F.col("_share"))))
    rows = points.join(counts.select("device_id", share.alias("_share")), "device_id").withColumn("_first", first)
    drawn = rows.where(F.col("_first") < trees).withColumn(
        "tree", F.explode(F.sequence(F.col("_first").cast("int"), F.lit(trees - 1)))
    )
    drawn = drawn.where((F.col("tree") == F.col("_first")) | (_uniform(*identity, F.col("tree")) < F.col("_share")))
    if short is not None:
        drawn = drawn.join(short, ["device_id", "tree"], "left_semi")
    draw = F.xxhash64(F.lit(seed), F.lit("rank"), "device_id", F.col(key), "tree")
    return drawn.drop("_share", "_first").withColumn("draw", draw)


def grow_trees(
    points: DataFrame, stats: DataFrame, features: Sequence[str], key: str, trees: int = S.TREES, seed: int = S.SEED,
    wider: float = 1.5,
) -> DataFrame:
    """Trees of every device in `stats`, each from its own uniform sample of 256 of all the device's rows.

    A tree keeps the candidates of the least draws. Trees that got too few candidates are drawn again from a share four
    times as wide, until none is short; the share of 1 gives all rows. Growing is grouped by device and a few trees.
    """
    features = list(features)
    columns = [f"z{i}" for i in range(len(features))]
    scaling = stats.select("device_id", "n_samples", "means", "deviations")

    def grow(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        device = int(group[0])
        size = min(S.TREE_SAMPLE, int(rows["n_samples"].iloc[0]))
        rows = rows.sort_values(["tree", "draw", "key"])
        rows = rows[rows.groupby("tree").cumcount() < size]
        found = rows["tree"].value_counts()
        whole = np.array(sorted(found.index[found == size]), dtype=np.int32)
        if not len(whole):
            return pd.DataFrame(columns=[part.split()[0] for part in TREE_SCHEMA.split(", ")])
        samples = rows.loc[rows["tree"].isin(whole), columns].to_numpy().reshape(len(whole), size, len(columns))
        grown = grow_forest(samples, [(seed, device & 0x7FFFFFFFFFFFFFFF, int(tree)) for tree in whole])
        return pd.DataFrame(
            {
                "device_id": device,
                "tree": whole,
                "sample_size": np.int32(size),
                "feature": list(grown["feature"]),
                "threshold": list(grown["threshold"]),
                "path": list(grown["path"]),
            }
        )

    counts = tabled(stats.select("device_id", "n_samples"))
    wanted = counts.select("device_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    found, short = [], None
    while True:
        drawn = tree_samples(points, counts, key, trees, seed, wider, short)
        drawn = drawn.select("device_id", "tree", "draw", F.col(key).alias("key"), *features).join(scaling, "device_id")
        drawn = drawn.select("device_id", "tree", "draw", "key", "n_samples", *scaled(features))
        block = F.floor(F.col("tree") / TREES_PER_GROUP).alias("block")
        found.append(tabled(drawn.groupBy("device_id", block).applyInPandas(grow, TREE_SCHEMA)))
        grown = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found)
        short = tabled(wanted.join(grown.select("device_id", "tree"), ["device_id", "tree"], "left_anti"))
        if short.isEmpty():
            return grown
        wider *= 4.0


def with_models(forests: DataFrame, models: DataFrame) -> DataFrame:
    """Trees that carry what a score needs of their model: scaling, limit and id. All of it is small."""
    model_id = F.col("id") if "id" in models.columns else F.lit(None)
    limit = F.col("threshold") if "threshold" in models.columns else F.lit(0.0)
    side = models.select(
        F.col("device_id").alias("_device"), "means", "deviations", limit.alias("limit"), model_id.cast("bigint").alias("_model")
    )
    trees = forests.select("device_id", "tree", "sample_size", "feature", "threshold", "path")
    joined = trees.join(side, F.col("device_id") == F.col("_device")).drop("_device")
    return joined.withColumnRenamed("_model", "model_id")


def apply(
    points: DataFrame,
    models: DataFrame,
    forests: DataFrame,
    features: Sequence[str],
    key: str,
    carry: Sequence[str],
    chunk: int = S.SCORING_CHUNK,
    keep_unscored: bool = False,
) -> DataFrame:
    """Add `decision` (negative is anomalous), `label` (-1 or 1) and `model_id` to points of devices with a model.

    Points are shuffled once: a device's points are cut into chunks by their key, as many as its count asks for, and
    every chunk meets a copy of the device's trees, which bring scaling, limit and model id with them. Only devices with
    more than one chunk are looked up; they are at most one per `chunk` points, in a table whose size Spark can see.
    With `keep_unscored`, points of devices without a model come back with nulls.
    """
    features, carried = list(features), [c for c in dict.fromkeys([key, *carry]) if c != "device_id"]
    inputs = [f"_x{i}" for i in range(len(features))]
    counted = points.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    many = tabled(
        counted.where(F.col("n") > chunk).select("device_id", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    )
    raw = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(x) for f, x in zip(features, inputs, strict=True)]
    number = F.pmod(F.xxhash64(key), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk")
    rows = points.select("device_id", *carried, *raw).join(many, "device_id", "left")
    rows = rows.select("device_id", number, *carried, *inputs)
    copies = with_models(forests, models).join(many.withColumnRenamed("device_id", "_of"), F.col("device_id") == F.col("_of"), "left")
    numbers = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    copies = copies.withColumn("chunk", F.explode(numbers)).drop("chunks", "_of")

    def score(points: pa.Table, trees: pa.Table) -> pa.Table:
        result = points.select(["device_id", *carried])
        count = points.num_rows if trees.num_rows or keep_unscored else 0
        result = result.slice(0, count)
        decision, label, model = pa.nulls(count, pa.float64()), pa.nulls(count, pa.int32()), pa.nulls(count, pa.int64())
        if count and trees.num_rows:
            trees = trees.sort_by("tree")
            names = ("feature", "threshold", "path")
            arrays = [trees[name].combine_chunks().flatten().to_numpy().reshape(trees.num_rows, -1) for name in names]
            means, deviations = (np.array(trees[name][0].as_py(), dtype=float) for name in ("means", "deviations"))
            values = np.stack([points[x].to_numpy() for x in inputs], axis=1)
            depth = mean_depth((values - means) / deviations, *arrays)
            norm = max(float(mean_path(trees["sample_size"][0].as_py())), 1e-12)
            decisions = -np.power(2.0, -depth / norm) - trees["limit"][0].as_py()
            decision, label = pa.array(decisions), pa.array(np.where(decisions < 0.0, -1, 1).astype(np.int32))
            model = pa.repeat(pa.scalar(trees["model_id"][0].as_py(), pa.int64()), count)
        for name, column in (("decision", decision), ("label", label), ("model_id", model)):
            result = result.append_column(name, column)
        return result

    kept = rows.select("device_id", *carried).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", decision double, label int, model_id bigint"
    return rows.groupBy("device_id", "chunk").cogroup(copies.groupBy("device_id", "chunk")).applyInArrow(score, schema)


def train(
    points: DataFrame,
    features: Sequence[str],
    key: str,
    trees: int = S.TREES,
    contamination: float = S.CONTAMINATION,
    min_rows: int = S.MIN_TRAINING_ROWS,
    seed: int = S.SEED,
) -> tuple[DataFrame, DataFrame]:
    """(models, forests) of all devices with enough rows.

    A model holds the scaling and the threshold: the share `contamination` of training rows scores below it.
    """
    rows = tabled(filled(points, features).select("device_id", key, *features))
    stats = tabled(feature_stats(rows, features, min_rows))
    forests = grow_trees(rows, stats, features, key, trees, seed)
    scores = tabled(apply(rows, stats, forests, features, key, []).select("device_id", "decision"))
    thresholds = exact_quantile(scores, ["device_id"], "decision", contamination, "threshold", 1e-4)
    names = F.array(*[F.lit(f) for f in features]).alias("features")
    models = stats.join(thresholds, "device_id").select(
        "device_id", names, "n_samples", "means", "deviations", "threshold"
    )
    return models, forests
