import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import isolation_forest as forest

COLUMNS = ("x", "y")


def grid(spark, n, parts=4):
    """Points in a unit square, and one far away."""
    df = spark.range(0, n, 1, parts).select(
        F.col("id").alias("transaction_id"),
        (F.xxhash64("id", F.lit(1)) % 1000 / 1000.0).alias("x"),
        (F.xxhash64("id", F.lit(2)) % 1000 / 1000.0).alias("y"),
    )
    far = F.col("transaction_id") == 7
    return df.withColumn("x", F.when(far, 40.0).otherwise(F.col("x")))


def test_average_path():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(10.2447, abs=1e-3)


def test_tree_is_sound():
    points = np.random.default_rng(3).normal(size=(256, 2))
    nodes = forest.grow_tree(points, np.random.default_rng(0))
    assert len(nodes) <= 511

    def leaves(at, rows, depth):
        feature, cut, left, right, path = nodes[at]
        if feature < 0:
            assert depth <= 8 and path == pytest.approx(depth + forest.average_path(len(rows)))
            return len(rows)
        low = rows[:, feature] <= cut
        assert 0 < low.sum() < len(rows)
        return leaves(left, rows[low], depth + 1) + leaves(right, rows[~low], depth + 1)

    assert leaves(0, points, 0) == 256


def test_constant_points_make_one_leaf():
    nodes = forest.grow_tree(np.ones((10, 2)), np.random.default_rng(0))
    assert len(nodes) == 1 and nodes[0][0] == -1


@pytest.fixture(scope="module")
def fitted(spark):
    rows = grid(spark, 3000)
    nodes = forest.fit_forest(rows, trees=50, columns=COLUMNS)
    return rows, nodes


def test_every_tree_has_a_full_sample(fitted):
    _, nodes = fitted
    sizes = nodes.groupBy("tree").agg(F.max("sample_size").alias("n"), F.count("*").alias("nodes")).collect()
    assert len(sizes) == 50 and {r["n"] for r in sizes} == {256}
    assert max(r["nodes"] for r in sizes) <= 511


def test_fit_does_not_depend_on_partitioning(spark, fitted):
    _, nodes = fitted
    again = forest.fit_forest(grid(spark, 3000, 9).repartition(3), trees=50, columns=COLUMNS)
    assert again.exceptAll(nodes).count() == 0 and nodes.count() == again.count()


def test_scores_equal_a_walk_by_hand(spark, fitted):
    rows, nodes = fitted
    scorer = forest.ForestScorer(nodes)
    scored = rows.withColumn("s", scorer.score(*COLUMNS)).orderBy("transaction_id").limit(40).collect()
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}

    def path(tree, point):
        node = table[tree, 0]
        while node["feature"] >= 0:
            side = "left" if point[node["feature"]] <= node["threshold"] else "right"
            node = table[tree, node[side]]
        return node["path"]

    for row in scored:
        mean = sum(path(t, (row["x"], row["y"])) for t in range(50)) / 50
        assert row["s"] == pytest.approx(2 ** (-mean / forest.average_path(256)) - 0.5, abs=1e-12)
    assert max(scored, key=lambda r: r["s"])["transaction_id"] == 7
    assert scored[7]["s"] > 0.1


def test_small_inputs_use_all_rows(spark):
    nodes = forest.fit_forest(grid(spark, 30), trees=5, columns=COLUMNS)
    assert {r[0] for r in nodes.select("sample_size").collect()} == {30}
    assert {r[0] for r in nodes.select("tree").collect()} == set(range(5))
    one = forest.ForestScorer(forest.fit_forest(grid(spark, 1), trees=5, columns=COLUMNS))
    assert not math.isnan(grid(spark, 1).select(one.score(*COLUMNS)).first()[0])


def test_dealt_rows_are_bounded(spark):
    for n in (500, 5_000, 60_000):
        dealt = forest.tree_rows(grid(spark, n), 200, 256).count()
        assert dealt <= 1.1 * 4 * 200 * 256


def test_fit_funnels_nothing_through_one_task(spark):
    nodes = forest.fit_forest(grid(spark, 3000), trees=5, columns=COLUMNS)
    text = nodes._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in text and "CollectLimit" not in text


def test_sizes_other_than_the_defaults_reload(spark):
    nodes = forest.fit_forest(grid(spark, 3000), trees=3, sample_size=1000, columns=COLUMNS)
    assert forest.ForestScorer(nodes).depth == 10


def test_guards(spark, fitted):
    _, nodes = fitted
    with pytest.raises(ValueError):
        forest.fit_forest(grid(spark, 10).where("false"), columns=COLUMNS)
    with pytest.raises(ValueError, match="nodes"):
        forest.ForestScorer(nodes, max_nodes=10)
