"""The distributed category dictionary against MLlib's indexer and preprocessor."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txrisk.operators import categories, features
from txrisk.settings import CATEGORICAL_FEATURES, NUMERIC_FEATURES


def rows(spark, n, seed):
    rng = random.Random(seed)
    names = [*(f"{c}{i}" for i in range(12) for c in "aé "), "Zürich", "", "a b", "_"]
    data = [
        (i, *(float(rng.randrange(5)) for _ in NUMERIC_FEATURES),
         *(rng.choice(names[:6 + 10 * k + seed]) for k in range(len(CATEGORICAL_FEATURES))))
        for i in range(n)
    ]
    numbers = ", ".join(f"{c} DOUBLE" for c in NUMERIC_FEATURES)
    texts = ", ".join(f"{c} STRING" for c in CATEGORICAL_FEATURES)
    return spark.createDataFrame(data, f"transaction_id BIGINT, {numbers}, {texts}").repartition(5)


@pytest.fixture(scope="module")
def train(spark):
    constant = rows(spark, 400, 3).withColumn("has_error", F.lit(1.0))
    return constant.persist()


@pytest.fixture(scope="module")
def test(spark):
    return rows(spark, 200, 8).persist()  # with values that training never saw


def test_slots_are_those_of_the_indexer(train, test):
    fitted = features.preprocessor().getStages()[0].fit(train)
    found = {(r.feature, r.slot): r.value for r in categories.category_dictionary(train).collect()}
    labels = {(c, i): v for c, own in zip(CATEGORICAL_FEATURES, fitted.labelsArray) for i, v in enumerate(own)}
    assert found == labels
    slots = categories.with_slots(test, categories.category_dictionary(train))
    both = fitted.transform(slots)
    for c in CATEGORICAL_FEATURES:
        assert both.where(F.col(f"{c}_slot") != F.col(f"{c}_index")).count() == 0
    assert slots.count() == test.count()


def test_vectors_are_those_of_the_preprocessor(train, test):
    fitted = features.fit_preprocessor(train)
    dictionary = categories.category_dictionary(train)
    entries = categories.sparse_entries(test, dictionary)
    scaled = categories.scaled_entries(entries, categories.entry_scales(train, dictionary))
    for column, ours in (("features_raw", entries), ("features", scaled)):
        dense = fitted.transform(test).select("transaction_id", F.posexplode(vector_to_array(column)).alias("p", "v"))
        wanted = {(r.transaction_id, r.p): r.v for r in dense.where("v <> 0").collect()}
        own = {(r.transaction_id, r.position): r.value for r in ours.collect()}
        assert own.keys() == wanted.keys()
        assert all(own[k] == pytest.approx(wanted[k], rel=1e-9) for k in own)


def test_ties_nulls_and_empty_tables(spark):
    table = spark.createDataFrame(
        [(1, "b", None), (2, "a", None), (3, "c", "x"), (4, "c", "x"), (5, None, None)], "transaction_id INT, u STRING, w STRING"
    )
    found = categories.category_dictionary(table, ("u", "w"))
    assert sorted((r.feature, r.slot, r.value, r.n) for r in found.collect()) == [
        ("u", 0, "c", 2), ("u", 1, "a", 1), ("u", 2, "b", 1), ("w", 0, "x", 2)
    ]
    slots = categories.with_slots(table, found, ("u", "w"))
    assert {r.transaction_id: (r.u_slot, r.w_slot) for r in slots.collect()} == {
        1: (2, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0), 5: (3, 1)
    }
    none = categories.category_dictionary(table.limit(0), ("u", "w"))
    assert none.count() == 0 and categories.category_widths(none, ("u", "w")) == {"u": 1, "w": 1}
    assert {r.u_slot for r in categories.with_slots(table, none, ("u", "w")).collect()} == {0}


def test_many_values_stay_in_tables(spark):
    """More values than the driver may hold; one of them with a third of the rows."""
    n = 200_000
    table = spark.range(n).select(
        F.col("id").alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.lpad("id", 7, "0"))).alias("u"),
    )
    dictionary = categories.category_dictionary(table, ("u",))
    values = n - (n + 2) // 3 + 1
    row = dictionary.agg(F.count("*"), F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()
    assert tuple(row) == (values, 0, values - 1, values)
    first = {r.value: r.slot for r in dictionary.where("slot < 3").collect()}
    assert first == {"hot": 0, "v0000001": 1, "v0000002": 2}
    slots = categories.with_slots(table, dictionary, ("u",))
    assert slots.where("u_slot = 0").count() == (n + 2) // 3 and slots.agg(F.max("u_slot")).first()[0] == values - 1


def test_no_task_holds_a_feature(train):
    """Values are placed by a range sort; windows run over one row for each part only."""
    ranked = categories.numbered(train.select("use_chip", "transaction_id"), "use_chip", "transaction_id")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
