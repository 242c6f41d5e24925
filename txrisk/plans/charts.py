"""The table behind every chart, from the labeled table and the stored predictions."""

from functools import reduce

from pyspark.sql import functions as F

from txrisk import settings
from txrisk.operators import metrics, profiling, reports
from txrisk.operators.classifiers import MODELS, model_spec
from txrisk.schemas import RESULT_TABLES
from txrisk.sources import readers, writers


IMPORTANCE = "slug STRING, feature STRING, importance DOUBLE"


def stored_predictions(spark, prediction_base, slugs=tuple(MODELS)):
    """Stored predictions of several models as one long table with their slug."""
    frames = (
        readers.read_table(spark, f"{prediction_base}/{slug}").withColumn("slug", F.lit(slug))
        for slug in slugs
    )
    return reduce(lambda a, b: a.unionByName(b), frames)


def amount_tables(labeled):
    """Class counts and the two clipped amount histograms."""
    fraud = labeled.where(F.col("class") == 1)
    return {
        "class_distribution": profiling.class_distribution(labeled).select("class", "count"),
        "amount_histogram": reports.clipped_histogram(labeled, "amount", 50, 0.01, 0.99),
        "fraud_amount_histogram": reports.clipped_histogram(fraud, "amount", 40, 0.0, 0.99),
    }


def charts(
    spark, labeled_path, prediction_base, result_dir, model=settings.DEFAULT_MODEL, report=None,
    importance_path=None,
):
    """Writes all chart tables and the top suspicious rows of one model; returns the report.

    ``importance_path`` is the importance table that evaluation wrote; it feeds the top features.
    """
    model_spec(model)
    labeled = readers.read_table(spark, labeled_path)
    own = readers.read_table(spark, f"{prediction_base}/{model}")
    tables = amount_tables(labeled)
    tables["probability_histogram"] = reports.histogram(own, "fraud_probability", 50, 0.0, 1.0)
    tables["precision_recall_curve"] = metrics.pr_curve(
        stored_predictions(spark, prediction_base), "fraud_probability"
    ).orderBy("slug", F.desc("threshold"))

    decided = own.withColumn("slug", F.lit(model))
    counts = metrics.confusion_counts(decided, label="actual_class")
    tables["confusion_matrix"] = metrics.confusion_matrix(counts, model).orderBy("actual", "predicted")
    if importance_path:
        importance = spark.read.csv(importance_path, schema=IMPORTANCE, header=True)
        tables["top_features"] = reports.top_features(importance).orderBy("slug", "rank")

    top_path = f"{prediction_base}/suspicious_transactions"
    writers.write_table(reports.top_suspicious(own), top_path)
    top = readers.read_table(spark, top_path)
    tables["top_suspicious_transactions"] = top.orderBy(
        F.desc("fraud_probability"), "transaction_id"
    )
    for name, table in tables.items():
        ordered = table.orderBy("bin") if "bin" in table.columns else table
        writers.write_result_table(ordered, f"{result_dir}/{name}.csv", RESULT_TABLES[name])

    importance_model = model if MODELS[model].is_forest else settings.DEFAULT_MODEL
    result = {
        "selected_model": model,
        "feature_importance_model": importance_model,
        "tables": sorted(tables),
        "top_suspicious_rows": top.count(),
        "top_suspicious_path": top_path,
    }
    if report:
        writers.write_report(spark, result, report)
    return result
