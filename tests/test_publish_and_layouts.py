"""Folders that are replaced only when finished, and columns told from footers."""

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from txrisk.operators.classifiers import logistic_regression
from txrisk.sources import layouts, model_store, publish, readers, writers


def value(spark, path):
    return [r[0] for r in spark.read.parquet(path).collect()]


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x INT")


def test_publish_replaces_a_checked_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        found = publish.publish(spark, path, numbers(spark, n).write.parquet, lambda name: value(spark, name))
        assert found == [n] and value(spark, path) == [n]
    assert publish.names_below(spark, str(tmp_path)) == ["t"]


@pytest.mark.parametrize("step", ["write", "check", "rename"])
def test_a_failed_publish_leaves_what_was_there(spark, tmp_path, step, monkeypatch):
    path = str(tmp_path / "t")
    publish.publish(spark, path, numbers(spark, 1).write.parquet, lambda name: None)

    def fail(*_):
        raise OSError("halfway")

    def write(name):
        numbers(spark, 2).write.parquet(name)
        if step == "write":
            fail()

    if step == "rename":
        inner = publish._renamed
        monkeypatch.setattr(publish, "_renamed", lambda s, old, new: fail() if "unfinished" in old else inner(s, old, new))
    with pytest.raises(OSError, match="halfway"):
        publish.publish(spark, path, write, fail if step == "check" else lambda name: None)
    assert value(spark, path) == [1] and publish.names_below(spark, str(tmp_path)) == ["t"]


def vectors(spark, n, sign=1.0):
    rows = spark.range(n).select(
        F.col("id").alias("transaction_id"), F.array((F.col("id") % 7).cast("double") * sign, F.lit(1.0)).alias("v"),
        (F.col("id") % 7 > 3).cast("int").alias("class"),
    )
    return rows.select("transaction_id", "class", array_to_vector("v").alias("features"))


def test_a_model_that_predicts_otherwise_is_not_stored(spark, tmp_path):
    path = str(tmp_path / "m")
    good, other = (logistic_regression().fit(vectors(spark, 200, s)) for s in (1.0, -1.0))
    check = vectors(spark, 10)
    saved = model_store.save_checked(good, path, LogisticRegressionModel.load, check)
    assert saved.coefficients == good.coefficients
    # A loader that gives another model scores as many rows, but not the same.
    with pytest.raises(RuntimeError, match="does not predict"):
        model_store.save_checked(other, path, lambda name: good, check)
    with pytest.raises(RuntimeError, match="does not predict"):
        model_store.save_checked(good, path, LogisticRegressionModel.load, check.limit(0))
    assert LogisticRegressionModel.load(path).coefficients == good.coefficients


def test_a_report_that_fails_leaves_the_last_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report.json")
    writers.write_report(spark, {"a": [1, "ä\nb"]}, path)
    monkeypatch.setattr(publish, "_renamed", lambda *_: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        writers.write_report(spark, {"a": 2}, path)
    assert readers.read_report(spark, path) == {"a": [1, "ä\nb"]}


def test_layouts_are_told_by_file(spark, tmp_path):
    rows = spark.range(6).select("id", F.lit("x").alias("name"), F.current_timestamp().alias("at"), (F.col("id") % 2).alias("y"))
    rows.coalesce(1).write.parquet(str(tmp_path / "good"))
    rows.drop("name").coalesce(1).write.parquet(str(tmp_path / "bad"))
    rows.withColumn("id", F.col("id").cast("string")).write.partitionBy("y").parquet(str(tmp_path / "parts"))
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    wanted = {"id": "bigint", "name": None, "at": "timestamp", "y": "bigint"}
    problems = layouts.layout_problems(layouts.file_columns(spark, str(tmp_path)), wanted).collect()
    found = {(r.path.split(str(tmp_path))[1].split("/")[1], r.column, r.problem) for r in problems}
    assert found == {("bad", "name", "missing"), ("parts", "id", "is string")}
    assert sum(r.rows for r in problems if r.column == "id") == 6
    with pytest.raises(ValueError, match="bad.*name missing"):
        layouts.require_layout(spark, str(tmp_path / "bad"), wanted)
    assert layouts.require_layout(spark, str(tmp_path / "good"), wanted)
    assert layouts.file_columns(spark, str(tmp_path / "good")).count() == 4
