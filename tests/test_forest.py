"""Properties of the isolation forests."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import forest
from waymark.plans import scoring

FEATURES = ("a", "b", "flat")
TREES = 60


def cloud(device, n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {"device_id": device, "id": np.arange(n), "a": rng.normal(0, 1, n), "b": rng.normal(5, 2, n), "flat": 3.0}
    )


@pytest.fixture(scope="module")
def points(spark):
    planted = pd.DataFrame({"device_id": 1, "id": [9000, 9001], "a": [9.0, -9.0], "b": [40.0, -30.0], "flat": 3.0})
    frames = [cloud(1, 2000, 1), planted, cloud(2, 300, 2), cloud(3, 49, 3), cloud(4, 50, 4)]
    return spark.createDataFrame(pd.concat(frames))


@pytest.fixture(scope="module")
def trained(points):
    models, forests = forest.train(points, FEATURES, "id", TREES)
    return models.checkpoint(), forests


def scores(points, trained):
    applied = forest.apply(points, *trained, FEATURES, "id", ["a"])
    return applied.toPandas().sort_values(["device_id", "id"]).reset_index(drop=True)


def test_small_devices_are_skipped(trained):
    assert {r["device_id"]: r["n_samples"] for r in trained[0].collect()} == {1: 2002, 2: 300, 4: 50}
    assert {r["device_id"] for r in trained[1].select("device_id").distinct().collect()} == {1, 2, 4}


def test_about_five_percent_of_training_rows_are_anomalous(points, trained):
    rates = scores(points, trained).groupby("device_id")["label"].apply(lambda s: (s == -1).mean())
    assert rates[1] == pytest.approx(0.05, abs=0.01)
    assert rates[2] == pytest.approx(0.05, abs=0.02)


def test_planted_outliers_rank_first(points, trained):
    got = scores(points, trained)
    worst = got[got["device_id"] == 1].nsmallest(20, "decision")
    assert {9000, 9001} <= set(worst["id"])


def test_result_does_not_depend_on_layout(points, trained):
    again = forest.train(points.repartition(23, F.rand(1)), FEATURES, "id", TREES)
    left, right = scores(points, trained), scores(points.repartition(3), (again[0].checkpoint(), again[1]))
    np.testing.assert_allclose(left["decision"], right["decision"], atol=1e-9)


def test_small_chunks_give_the_same_scores(points, trained):
    order = ["device_id", "id"]
    whole, cut = (
        forest.apply(points, *trained, FEATURES, "id", ["a"], chunk=chunk).toPandas().sort_values(order).reset_index(drop=True)
        for chunk in (50_000, 100)
    )
    pd.testing.assert_frame_equal(whole, cut)


def test_unscored_points_are_kept_when_asked_for(points, trained):
    kept = forest.apply(points, *trained, FEATURES, "id", [], keep_unscored=True).toPandas()
    assert len(kept) == points.count() and set(kept.loc[kept["decision"].isna(), "device_id"]) == {3}


def test_threshold_is_the_quantile_of_the_forest_scores(points, trained):
    """The exact quantile over the scores of trained trees, against NumPy on the same trees."""
    models, forests = (df.toPandas() for df in trained)
    rows = points.toPandas()
    for _, model in models.iterrows():
        trees = forests[forests["device_id"] == model["device_id"]].sort_values("tree")
        own = rows.loc[rows["device_id"] == model["device_id"], list(FEATURES)].to_numpy()
        z = (own - np.array(model["means"])) / np.array(model["deviations"])
        depth = forest.mean_depth(z, *[np.stack(trees[name].to_numpy()) for name in ("feature", "threshold", "path")])
        scores = -np.power(2.0, -depth / forest.mean_path(trees["sample_size"].iloc[0]))
        assert model["threshold"] == pytest.approx(np.quantile(scores, 0.05), abs=1e-12)


def exchanges_above(plan, mark: str) -> int:
    """Shuffles on the way from the scan of the column `mark` to the root; broadcasts do not count."""
    text = plan.toString()
    if mark not in text:
        return 0
    name = plan.nodeName()
    children = plan.children()
    below = max((exchanges_above(children.apply(i), mark) for i in range(children.size())), default=0)
    if name == "AdaptiveSparkPlan":
        below = exchanges_above(plan.initialPlan(), mark)
    return below + (name == "Exchange")


def test_points_are_shuffled_once_to_be_scored(spark, points, trained, tmp_path):
    points.write.parquet(f"file://{tmp_path}/to_be_scored")
    stored = spark.read.parquet(f"file://{tmp_path}/to_be_scored")
    scored = forest.apply(stored, *trained, FEATURES, "id", ["a"], chunk=100)
    assert exchanges_above(scored._jdf.queryExecution().executedPlan(), "flat#") == 1


def test_constant_features_never_split(trained):
    used = trained[1].select(F.explode("feature").alias("f")).where("f >= 0").distinct().collect()
    assert {r["f"] for r in used} == {0, 1}


def test_trees_are_sound():
    rng = np.random.default_rng(0)
    grown = forest.grow_forest(rng.normal(size=(10, 256, 3)), [(42, tree) for tree in range(10)])
    assert grown["feature"].shape == (10, 511)
    depth = forest.mean_depth(rng.normal(size=(50, 3)), grown["feature"], grown["threshold"], grown["path"])
    assert (depth > 1).all() and (depth < 20).all()


def test_identical_rows_make_a_leaf():
    grown = forest.grow_forest(np.ones((3, 256, 2)), [(42, 1), (42, 2), (42, 3)])
    assert (grown["feature"] == -1).all()
    np.testing.assert_allclose(grown["path"][:, 0], forest.mean_path(np.array([256]))[0])


def test_mean_path():
    np.testing.assert_allclose(forest.mean_path(np.array([1, 2, 256])), [0.0, 1.0, 10.2447], atol=1e-3)


def test_missing_model_is_unknown(spark, points, trained):
    registered = scoring._register(
        trained, scoring.ROUTE_MODEL, "2024-01-31T00:00:00+00:00", lambda today: F.date_sub(today, 20)
    )
    newest, trees = scoring.current(*registered, scoring.ROUTE_MODEL)
    assert newest.count() == 3 and trees.count() == 3 * TREES
    assert scoring.current(*registered, scoring.SENSOR_MODEL)[0].count() == 0


def test_newest_model_wins(trained):
    first = scoring._register(trained, scoring.ROUTE_MODEL, "2024-01-30T00:00:00+00:00", lambda d: d)
    second = scoring._register(trained, scoring.ROUTE_MODEL, "2024-01-31T00:00:00+00:00", lambda d: d)
    both = [a.unionByName(b) for a, b in zip(first, second)]
    newest, trees = scoring.current(*both, scoring.ROUTE_MODEL)
    assert {str(r["trained_to"]) for r in newest.collect()} == {"2024-01-31"}
    assert trees.count() == 3 * TREES


def large(spark, count):
    return spark.range(count).selectExpr(
        "id", "if(id < 300, 2, 1) as device_id", "cast(id % 1009 as double) as a", "cast(id % 577 as double) as b"
    )


def brute_force_samples(rows, count, trees, seed, wider):
    """Rows (as places) of every tree of one device, from the hashes of all its rows with all trees."""
    share = min(1.0, wider * 256 / count)

    def uniform(*parts):
        hashes = rows.select(F.xxhash64(*parts).alias("h")).toPandas()["h"].to_numpy()
        return (hashes.astype(float) + 2.0**63 + 0.5) / 2.0**64

    base = [F.lit(seed), F.lit(wider), F.col("device_id"), F.col("id")]
    with np.errstate(divide="ignore"):
        first = np.zeros(count) if share == 1 else np.floor(np.log(uniform(*base)) / np.log1p(-share))
    for tree in range(trees):
        number = F.lit(tree)
        inside = (first == tree) | ((first < tree) & (uniform(*base, number) < share))
        draw = rows.select(F.xxhash64(F.lit(seed), F.lit("rank"), "device_id", "id", number).alias("h")).toPandas()["h"].to_numpy()
        places = np.flatnonzero(inside)
        yield places[np.argsort(draw[places], kind="stable")][: min(256, count)]


def test_trees_equal_a_brute_force_draw(spark):
    rows = large(spark, 60_000)
    stats = forest.feature_stats(rows, ["a", "b"])
    trees = forest.grow_trees(rows, stats, ["a", "b"], "id", trees=4).toPandas()
    assert sorted(zip(trees["device_id"], trees["tree"])) == [(d, t) for d in (1, 2) for t in range(4)]
    assert set(trees["sample_size"]) == {256}
    for device in (1, 2):
        own = rows.where(F.col("device_id") == device).orderBy("id")
        values = own.toPandas()[["a", "b"]].to_numpy()
        z = (values - values.mean(axis=0)) / values.std(axis=0)
        for tree, places in enumerate(brute_force_samples(own, len(values), 4, 42, 1.5)):
            wanted = forest.grow_forest(z[places][None], [(42, device, tree)])
            got = trees[(trees["device_id"] == device) & (trees["tree"] == tree)].iloc[0]
            assert list(got["feature"]) == list(wanted["feature"][0])
            np.testing.assert_allclose(got["threshold"], wanted["threshold"][0], atol=1e-9)
            np.testing.assert_allclose(got["path"], wanted["path"][0])


def test_trees_draw_from_all_rows_of_a_large_device(spark):
    """From a pool of trees x 256 rows, 200 trees would show at most 63 % as many rows as they draw."""
    rows = spark.range(400_000).selectExpr("id", "1L as device_id")
    counts = rows.groupBy("device_id").agg(F.count("id").alias("n_samples"))
    ranked = forest.tree_samples(rows, counts, "id", 200, 42).toPandas()
    assert len(ranked) < 200 * 256 * 1.6
    kept = ranked.sort_values(["tree", "draw"]).groupby("tree").head(256)
    assert len(kept) == 200 * 256
    assert kept["id"].nunique() == pytest.approx(400_000 * (1 - np.exp(-200 * 256 / 400_000)), rel=0.01)
    # every part of the rows is drawn alike, and two trees share no more rows than by chance
    parts = np.bincount(kept["id"] // 40_000)
    assert parts.min() > 0.93 * kept["id"].size / 10 and parts.max() < 1.07 * kept["id"].size / 10
    of_trees = [set(own) for _, own in kept.groupby("tree")["id"]]
    assert np.mean([len(one & two) for one, two in zip(of_trees, of_trees[1:], strict=False)]) < 0.4


def test_short_trees_are_drawn_again(spark):
    rows = large(spark, 5_000)
    stats = forest.feature_stats(rows, ["a", "b"])
    trees = forest.grow_trees(rows, stats, ["a", "b"], "id", trees=25, wider=0.9).toPandas()
    assert sorted(zip(trees["device_id"], trees["tree"])) == [(d, t) for d in (1, 2) for t in range(25)]
    assert set(trees["sample_size"]) == {256}
