"""The workflows end to end, each on what the one before stored."""

import pathlib

import pytest
from pyspark.sql import functions as F

from txrisk.catalog.tables import as_csv
from txrisk.operators import classifiers, features, isolation_forest
from txrisk.plans import charts, evaluate, predict, prepare, review, train, verify
from txrisk.schemas import RESULT_TABLES
from txrisk.sources import model_store, readers


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    return str(tmp_path_factory.mktemp("work"))


@pytest.fixture(scope="module")
def prepared(spark, views, base):
    return prepare.prepare(
        spark, as_csv(views.raw, "raw"), as_csv(views.raw_labels, "labels"), f"{base}/clean", f"{base}/labeled",
        f"{base}/prepare.json",
    )


@pytest.fixture(scope="module")
def trained(spark, prepared, base):
    return train.train(
        spark, f"{base}/labeled", f"{base}/splits", f"{base}/models", trees=10, depth=5
    )


@pytest.fixture(scope="module")
def evaluated(spark, trained, base):
    return evaluate.evaluate(
        spark, f"{base}/splits", f"{base}/models", f"{base}/predictions", f"{base}/results"
    )


def test_prepare(spark, views, prepared, base):
    tables = prepared["tables"]
    assert tables["raw"]["rows"] == views.raw.count() and tables["raw"]["columns"] == 12
    assert tables["clean"]["rows"] == spark.read.parquet(f"{base}/clean").count() == views.clean.count()
    assert tables["labeled"]["rows"] == views.labeled.count() == sum(c["count"] for c in prepared["classes"])
    assert tables["clean"]["left_out"] == tables["raw"]["rows"] - tables["clean"]["rows"]
    assert readers.read_report(spark, f"{base}/prepare.json")["tables"] == tables
    years = spark.read.parquet(f"{base}/labeled").select("transaction_year").distinct().count()
    files = len(list(pathlib.Path(f"{base}/labeled").glob("transaction_year=*/*.parquet")))
    assert files == years  # one file a year, however many tasks wrote them
    stored = spark.read.parquet(f"{base}/labeled").select(*views.labeled.columns)
    assert stored.exceptAll(views.labeled).count() == 0


def test_prepare_from_label_map(spark, views, base, prepared, tmp_path):
    import json

    pairs = {str(r["transaction_id"]): "Yes" if r["class"] else "No" for r in views.labels.collect()}
    (tmp_path / "labels.json").write_text(json.dumps({"target": pairs}))
    again = prepare.prepare(
        spark, as_csv(views.raw, "raw"), str(tmp_path / "labels.json"), str(tmp_path / "clean"),
        str(tmp_path / "labeled"), label_format="json",
    )
    assert again["classes"] == prepared["classes"]


def test_train(spark, trained, prepared, base):
    splits = trained["splits"]
    total = sum(c["rows"] for part in splits for c in part["classes"])
    assert total == prepared["tables"]["labeled"]["rows"]
    assert sum(part["share"] for part in splits) == pytest.approx(1.0, abs=1e-6)
    weights = {c["class"]: c["weight"] for c in trained["balancing"]["capped"]}
    assert weights[1] > 1 > weights[0]
    names = trained["preprocessor"]["vector"]
    assert not any(n.startswith(("class", "transaction_id", "client", "card", "merchant_id")) for n in names)
    assert {fit["slug"] for fit in trained["fits"]} == {*classifiers.MODELS, "isolation_forest"}


def test_preprocessor_saw_training_rows_only(spark, trained, base):
    fitted = model_store.load_preprocessor(f"{base}/models")
    train_rows = train.read_split(spark, f"{base}/splits", "train")
    seen = {r[0] for r in train_rows.select("mcc_category").distinct().collect()}
    assert set(fitted.stages[0].labelsArray[1]) == seen
    # One slot per label and one for labels never seen.
    vectors = fitted.transform(train_rows)
    widths = sum(len(labels) + 1 for labels in fitted.stages[0].labelsArray)
    assert len(features.feature_names(vectors)) == 8 + widths == vectors.first()["features"].size


def test_unseen_categories_still_score(spark, trained, base):
    fitted = model_store.load_preprocessor(f"{base}/models")
    rows = train.read_split(spark, f"{base}/splits", "test").limit(3).withColumn("mcc_category", F.lit("never seen"))
    model = model_store.load_classifier("lr_none", f"{base}/models")
    assert model.transform(fitted.transform(rows)).count() == 3


def test_one_class_is_an_error(spark, trained, base, tmp_path):
    only = spark.read.parquet(f"{base}/labeled").where("class = 0")
    only.write.parquet(str(tmp_path / "one"))
    with pytest.raises(ValueError, match="both classes"):
        train.train(spark, str(tmp_path / "one"), str(tmp_path / "s"), str(tmp_path / "m"))


def test_id_like_category_is_refused(spark, trained, base):
    rows = train.read_split(spark, f"{base}/splits", "train")
    wide = rows.withColumn("mcc_category", F.col("transaction_id").cast("string"))
    with pytest.raises(ValueError, match="mcc_category"):
        features.require_bounded_categories(wide, limit=100)


def test_score_all_equals_one_by_one(spark, trained, base):
    fitted = model_store.load_preprocessor(f"{base}/models")
    rows = fitted.transform(train.read_split(spark, f"{base}/splits", "test"))
    models = {s: model_store.load_classifier(s, f"{base}/models") for s in classifiers.MODELS}
    together = classifiers.score_all(models, rows)
    from txrisk.operators.reports import score_rows

    for slug, model in models.items():
        alone = score_rows(model, rows, 0.5).select("transaction_id", "fraud_probability")
        own = together.where(F.col("slug") == slug).select("transaction_id", "fraud_probability")
        assert own.count() == rows.count() and own.exceptAll(alone).count() == 0


def test_evaluate_and_verify(spark, evaluated, base):
    assert {r["slug"] for r in evaluated["models"]} == {*classifiers.MODELS, "isolation_forest"}
    checked = verify.verify_evaluation(spark, readers.read_report(spark, f"{base}/models/metadata/evaluation.json"))
    rows = evaluated["rows"]["test"]
    assert all(c["rows"] == rows for c in checked.values())
    for name in ("model_comparison", "imbalance_experiments", "confusion_matrices", "threshold_analysis", "rf_feature_importance"):
        table = spark.read.csv(f"{base}/results/{name}.csv", header=True)
        assert tuple(table.columns) == RESULT_TABLES[name] and table.count() > 0
    assert spark.read.csv(f"{base}/results/imbalance_experiments.csv", header=True).count() == 5
    broken = {**evaluated, "selection": {**evaluated["selection"], "recommended_model": "isolation_forest"}}
    broken["selection"]["thresholds_by_model"] = {**evaluated["selection"]["thresholds_by_model"], "lr_none": 1.5}
    with pytest.raises(RuntimeError) as raised:  # all of it is told at once
        verify.verify_evaluation(spark, broken)
    assert "recommended" in str(raised.value) and "lr_none: the threshold lies in [0, 1]" in str(raised.value)


def test_all_models_reload(spark, trained, base):
    scored = verify.verify_models(spark, f"{base}/splits", f"{base}/models", rows=50)
    assert scored == dict.fromkeys([*classifiers.MODELS, "isolation_forest"], 50)


def test_charts(spark, evaluated, base):
    slug = evaluated["selection"]["recommended_model"]
    report = charts.charts(
        spark, f"{base}/labeled", f"{base}/predictions", f"{base}/results", slug,
        importance_path=f"{base}/results/rf_feature_importance.csv",
    )
    assert {"confusion_matrix", "top_features"} <= set(report["tables"])
    seen = review.review(spark, f"{base}/predictions", slug, minimum=0.1, rows=5)
    assert len(seen["rows"]) <= 5 and seen["summary"]["suspicious"] >= len(seen["rows"])
    assert len(review.preview(spark, f"{base}/labeled", 3)) == 3
    assert report["top_suspicious_rows"] <= 20
    for name in report["tables"]:
        table = spark.read.csv(f"{base}/results/{name}.csv", header=True)
        assert tuple(table.columns) == RESULT_TABLES[name]
    curve = spark.read.csv(f"{base}/results/precision_recall_curve.csv", header=True)
    assert curve.select("slug").distinct().count() == 5
    with pytest.raises(ValueError):
        charts.charts(spark, f"{base}/labeled", f"{base}/predictions", f"{base}/results", "nope")


def test_predict_new_rows(spark, evaluated, views, base, tmp_path):
    from txrisk.operators.cleaning import unlabeled_transactions

    new = unlabeled_transactions(views.clean, views.labels).where("mcc is not null").select(
        "transaction_id", F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss").alias("transaction_time"),
        "amount", "use_chip", "merchant_state", "mcc", "errors",
    )
    report = predict.predict(
        spark, as_csv(new, "new"), f"{base}/new", f"{base}/models", report=f"{base}/new.json", export=f"{base}/new_csv"
    )
    assert report["rows"]["scored"] == new.count() > 0
    chosen = evaluated["selection"]
    assert report["scored_by"] == {"model": chosen["recommended_model"], "threshold": chosen["recommended_threshold"]}
    export = spark.read.csv(f"{base}/new_csv", header=True, inferSchema=True)
    scores = [r["fraud_probability"] for r in export.collect()]
    assert len(scores) == report["rows"]["scored"] and scores == sorted(scores, reverse=True)
    charts.charts(spark, f"{base}/labeled", f"{base}/predictions", f"{base}/results", report["scored_by"]["model"])
    final = verify.verify_final(
        spark, f"{base}/new", f"{base}/predictions/suspicious_transactions", readers.read_report(spark, f"{base}/new.json")
    )
    assert final["new_prediction"]["rows"] == report["rows"]["scored"]
    for bad in ({"model": "nope"}, {"threshold": 1.5}):
        with pytest.raises(ValueError):
            predict.predict(spark, as_csv(new, "new"), f"{base}/x", f"{base}/models", **bad)


def test_defaults_without_a_selection():
    assert predict.choose_model({}) == ("rf_undersampling", 0.5)
    assert predict.choose_model({"recommended_model": "lr_none", "thresholds_by_model": {"lr_none": 0.3}}) == ("lr_none", 0.3)
    assert predict.choose_model({"thresholds_by_model": {"rf_none": 0.7}}, "rf_none") == ("rf_none", 0.7)
    assert predict.choose_model({}, "rf_none", 0.0) == ("rf_none", 0.0)


def test_stored_forest_scores_like_the_fitted_one(spark, trained, base):
    rows = train.read_split(spark, f"{base}/splits", "test")
    nodes = isolation_forest.fit_forest(train.read_split(spark, f"{base}/splits", "train"))
    fresh = isolation_forest.score_forest(isolation_forest.ForestScorer(nodes), rows)
    stored = isolation_forest.score_forest(model_store.load_forest(spark, f"{base}/models"), rows)
    assert fresh.exceptAll(stored).count() == 0
