"""Thresholds from validation rows, results from test rows, and the recommended model."""

from functools import reduce

from pyspark.sql import functions as F

from txrisk import settings
from txrisk.operators import audits, classifiers, features, isolation_forest, metrics, reports
from txrisk.plans.train import read_split
from txrisk.schemas import RESULT_TABLES
from txrisk.session import written
from txrisk.sources import model_store, writers


def choose_thresholds(scored, thresholds=settings.THRESHOLDS, score="fraud_probability"):
    """(slug, threshold, rates, pr_auc): one row per model, from long scored rows."""
    sweep = metrics.threshold_sweep(scored, score, thresholds)
    return metrics.select_thresholds(sweep).join(metrics.area_under_pr(scored, score), "slug")


def decide(scored, thresholds, score="fraud_probability"):
    """Adds the 0/1 decision at each row's own model's threshold."""
    rule = reduce(
        lambda chain, item: chain.when(F.col("slug") == item[0], F.lit(float(item[1]))),
        thresholds.items(),
        F,
    )
    return scored.withColumn("prediction", (F.col(score) >= rule).cast("int"))


def evaluate_scored(decided, score="fraud_probability"):
    """(slug, counts, rates, pr_auc) of long decided rows."""
    return metrics.binary_metrics(decided).join(metrics.area_under_pr(decided, score), "slug")


def describe_models(results):
    """Adds each slug's display name and balancing method."""
    names = {s: (m.family, m.balancing) for s, m in classifiers.MODELS.items()}
    names[settings.FOREST_SLUG] = ("Isolation Forest", "Unsupervised")

    def pick(position):
        return reduce(
            lambda chain, s: chain.when(F.col("slug") == s, names[s][position]), names, F
        )

    return results.select("*", pick(0).alias("model"), pick(1).alias("imbalance_method"))


def result_tables(compared, sweep, importance=None):
    """The comparison, imbalance, confusion, threshold and importance tables.

    Takes frames that went through :func:`describe_models`.
    """
    tables = {
        "model_comparison": compared,
        "imbalance_experiments": compared.where(F.col("slug") != settings.FOREST_SLUG),
        "confusion_matrices": compared,
        "threshold_analysis": sweep,
    }
    if importance is not None:
        tables["rf_feature_importance"] = reports.sorted_importance(importance)
    return {name: df.select(*RESULT_TABLES[name]) for name, df in tables.items()}


def evaluate(
    spark,
    split_base,
    model_base,
    prediction_base,
    result_dir,
    report=None,
    thresholds=settings.THRESHOLDS,
):
    """Scores, measures and stores the predictions of all six models; returns the report."""
    fitted = model_store.load_preprocessor(model_base)
    validation = read_split(spark, split_base, "validation")
    test = read_split(spark, split_base, "test")
    audits.require_times(validation=validation, test=test)
    models = {slug: model_store.load_classifier(slug, model_base) for slug in classifiers.MODELS}
    test_features = fitted.transform(test)

    validated = written(
        classifiers.score_all(models, fitted.transform(validation), "class").select(
            "slug", "class", "fraud_probability"
        ),
        "validation-scores", "slug",
    )
    selection = written(choose_thresholds(validated, thresholds), "selection")
    selected = {row["slug"]: row.asDict() for row in selection.collect()}
    recommended = metrics.recommend_model(selection).first().asDict()
    chosen = {slug: row["threshold"] for slug, row in selected.items()}

    tested = written(
        classifiers.score_all(models, test_features, "class"), "test-scores", "slug"
    )
    decided = decide(tested, chosen)
    scorer = model_store.load_forest(spark, model_base)
    outliers = written(
        isolation_forest.score_forest(scorer, test, "class"), "forest-scores"
    ).withColumn("slug", F.lit(settings.FOREST_SLUG))

    compared = evaluate_scored(decided).unionByName(evaluate_scored(outliers, "anomaly_score"))
    compared = written(describe_models(compared), "model-metrics")
    sweep = metrics.threshold_sweep(tested, "fraud_probability", thresholds)
    sweep = written(describe_models(sweep), "threshold-sweep")
    test_rows = test.count()
    if audits.metric_violations(compared, test_rows).count():
        raise RuntimeError("confusion counts do not add up to the test rows")

    paths = {}
    for slug in classifiers.MODELS:
        own = decided.where(F.col("slug") == slug)
        table = reports.prediction_table(own, slug)
        paths[slug] = writers.write_table(table, f"{prediction_base}/{slug}", "prediction")
    paths[settings.FOREST_SLUG] = writers.write_table(
        reports.prediction_table(outliers, settings.FOREST_SLUG, "anomaly_score"),
        f"{prediction_base}/{settings.FOREST_SLUG}", "prediction",
    )
    for slug, path in paths.items():
        writers.reconcile(spark, path, test_rows, f"predictions of {slug}")

    names = features.feature_names(test_features)
    importance = reduce(
        lambda a, b: a.unionByName(b),
        (
            classifiers.feature_importance(spark, slug, model, names)
            for slug, model in models.items()
            if classifiers.MODELS[slug].is_forest
        ),
    )
    for name, table in result_tables(compared, sweep, importance).items():
        writers.write_result_table(table, f"{result_dir}/{name}.csv")

    measured = ("tp", "tn", "fp", "fn", "precision", "recall", "f1", "pr_auc", "accuracy", "specificity")
    result = {
        "rows": {"validation": recommended["evaluation_rows"], "test": test_rows},
        "models": [
            {
                "slug": row["slug"],
                "threshold": chosen.get(row["slug"]),
                "predictions": paths[row["slug"]],
                "metrics": {name: row[name] for name in measured},
            }
            for row in compared.orderBy("slug").collect()
        ],
        "tables": result_dir,
        "selection": {
            "recommended_model": recommended["slug"],
            "recommended_threshold": recommended["threshold"],
            "thresholds_by_model": chosen,
            "criterion": "validation PR-AUC, then validation F1, then precision",
            "validation_results": sorted(selected.values(), key=lambda r: r["slug"]),
        },
    }
    writers.write_report(spark, result, f"{model_base}/{settings.EVALUATION_REPORT}")
    if report:
        writers.write_report(spark, result, report)
    return result
