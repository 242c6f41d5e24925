"""Certificates of fits must fail for wrong fits; bucketed tables must join without a shuffle."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from txrisk.catalog import models
from txrisk.operators import certificates, classifiers
from txrisk.sources.buckets import open_bucketed, store_bucketed

PENALTY = 0.01


@pytest.fixture(scope="module")
def rows(spark):
    """Two numbers that tell the class in part, one that doesn't, and a weight."""
    def draw(seed):
        return (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) / 10_000.0)

    x = spark.range(6000).select("id", *(draw(s).alias(f"x{s}") for s in range(3)), draw(9).alias("u"), draw(10).alias("v"))
    y = (F.col("u") < 0.1 + 0.5 * F.col("x0") * F.col("x1")).cast("int")
    found = x.select(
        "id", array_to_vector(F.array("x0", "x1", "x2")).alias("features"), y.alias("class"),
        (F.col("v") < 0.25).cast("int").alias("other"), F.when(y == 1, 2.5).otherwise(0.7).alias("class_weight"),
    )
    return found.persist()


@pytest.mark.parametrize("weight", [None, "class_weight"])
def test_logistic_certificate(rows, weight):
    right = classifiers.logistic_regression(weight).fit(rows)
    found = certificates.logistic_certificate(rows, right, PENALTY, weight)
    assert found["loss"] < found["flat_loss"] and found["gradient"] < 0.01
    assert certificates.is_certified(rows, right, PENALTY, weight)
    wrong_label = classifiers.logistic_regression(weight).setLabelCol("other").fit(rows)
    assert not certificates.is_certified(rows, wrong_label, PENALTY, weight)
    wrong_weight = classifiers.logistic_regression(None if weight else "class_weight").fit(rows)
    assert not certificates.is_certified(rows, wrong_weight, PENALTY, weight)


def test_gradient_is_that_of_the_loss(rows):
    """Against differences of the loss around a model that is not at its minimum."""
    few = rows.limit(300).persist()
    model = classifiers.logistic_regression().setMaxIter(1).fit(few)
    _, loss, slope, height = certificates._loss_and_gradient(few, certificates.margin(model), None, "class")
    step = 1e-5
    for i in range(3):
        moved = certificates.margin(model) + step * certificates.vector_to_array("features")[i]
        assert (certificates._loss_and_gradient(few, moved, None, "class")[1] - loss) / step == pytest.approx(slope[i], abs=1e-4)
    moved = certificates.margin(model) + step
    assert (certificates._loss_and_gradient(few, moved, None, "class")[1] - loss) / step == pytest.approx(height, abs=1e-4)


@pytest.mark.parametrize("weight", [None, "class_weight"])
def test_forest_certificate(rows, weight):
    right = classifiers.random_forest(weight, trees=5, depth=5).fit(rows)
    found = certificates.forest_certificate(rows, right, weight).collect()
    assert len(found) == 5 and all(r.rows == 6000 for r in found)
    assert certificates.is_certified(rows, right, PENALTY, weight)
    shuffled = classifiers.random_forest(weight, trees=5, depth=5).setLabelCol("other").fit(rows)
    assert not certificates.is_certified(rows, shuffled, PENALTY, weight)


@pytest.mark.parametrize("weight", [None, "class_weight"])
def test_deviation_is_that_of_every_row_in_its_leaf(rows, weight):
    """Sums by class and one vector of a leaf tell as much as each row and each tree by itself."""
    model = classifiers.random_forest(weight, trees=3, depth=4).fit(rows)
    found = {r.tree: r for r in certificates.forest_certificate(rows, model, weight).collect()}
    for i, tree in enumerate(model.trees):
        own = tree.copy().setLeafCol("leaf").setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("")
        leaves = {}
        for r in own.transform(rows).collect():
            w = getattr(r, weight) if weight else 1.0
            leaves.setdefault(r.leaf, []).append(w * (r["class"] - r.p[1]))
        spreads = [(sum(v) ** 2, sum(x * x for x in v)) for v in leaves.values()]
        assert found[i].deviation == pytest.approx(sum(a / b if b else 0.0 for a, b in spreads) / len(leaves), rel=1e-6)
        assert (found[i].leaves, found[i].rows) == (len(leaves), 6000)


def test_training_vectors_are_stored_once_for_all_classifiers(rows, monkeypatch):
    names = []
    monkeypatch.setattr(models, "written", lambda df, name: names.append(name) or df)
    fitted = object.__new__(models.Fitted)
    fitted.train = rows.withColumnRenamed("id", "transaction_id")
    fitted.splits = {"train": fitted.train}
    found = {slug: fitted.training_rows(slug) for slug in classifiers.MODELS}
    assert names == ["training-vectors", "undersampled-vectors"]
    assert found["lr_none"].count() == found["rf_class_weight"].count() == 6000
    assert found["rf_undersampling"].where("class = 1").count() == rows.where("class = 1").count()
    assert set(found["rf_none"].columns) == {"transaction_id", "class", "features"}


def test_bucketed_tables_join_and_group_without_a_shuffle(spark, tmp_path):
    left = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("a"))
    right = spark.range(0, 1000, 3).select(F.col("id").alias("k"), F.lit(1).alias("b"))
    tables = []
    for name, df in (("left", left), ("it's right", right)):
        path = str(tmp_path / name)
        stored = store_bucketed(df, path, "k", 4)
        tables.append(open_bucketed(spark, path, stored.schema, "k", 4))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = tables[0].join(tables[1], "k")
        regrouped = joined.groupBy("k").agg(F.sum("b").alias("n"))
        for df in (joined, regrouped):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plain = left.join(right, "k")
        assert sorted(joined.collect()) == sorted(plain.collect()) and regrouped.count() == 334
        # A new pass over the same path takes the place of the table.
        again = store_bucketed(right, str(tmp_path / "left"), "k", 4)
        assert again.count() == right.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
