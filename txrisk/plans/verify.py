"""Checks of stored artefacts, meant to run in an application of their own."""

from pyspark.sql import functions as F

from txrisk import settings
from txrisk.operators import audits
from txrisk.operators.classifiers import MODELS
from txrisk.operators.keys import require_columns
from txrisk.plans.train import read_split
from txrisk.schemas import NEW_PREDICTION_COLUMNS
from txrisk.sources import model_store, readers

PREDICTION_COLUMNS = (
    "transaction_id", "transaction_time", "amount", "prediction", "status", "actual_class",
    "model",
)


METRICS = (
    "slug STRING, tp BIGINT, tn BIGINT, fp BIGINT, fn BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE, "
    "pr_auc DOUBLE, accuracy DOUBLE"
)


def verify_models(spark, split_base, model_base, rows=100):
    """Every stored model loads and scores the same few test rows."""
    test = read_split(spark, split_base, "test")
    checked = model_store.check_all_models(spark, model_base, test, rows)
    expected = test.limit(rows).count()
    scored = {row["slug"]: row["scored"] for row in checked.collect()}
    short = {slug: n for slug, n in scored.items() if n != expected}
    if short:
        raise RuntimeError(f"expected {expected} scored rows, found {short}")
    return scored


def _expectations(spark, report):
    """(rule, subject, holds) of what the report says by itself, every rule for every model."""
    selection = report.get("selection", {})
    limits = selection.get("thresholds_by_model", {})
    models = {m["slug"]: m for m in report.get("models", [])}
    rows = [("a classifier is recommended", "selection", selection.get("recommended_model") in MODELS)]
    rows += [("no other models are reported", slug, slug in MODELS or slug == settings.FOREST_SLUG) for slug in models]
    for slug in (*MODELS, settings.FOREST_SLUG):
        rows.append(("the model is reported", slug, slug in models))
    for slug in MODELS:
        limit = limits.get(slug, -1.0)
        rows.append(("the threshold lies in [0, 1]", slug, 0.0 <= limit <= 1.0))
        rows.append(("the threshold is the selected one", slug, models.get(slug, {}).get("threshold") == limit))
    return spark.createDataFrame(rows, "rule STRING, subject STRING, holds BOOLEAN")


def _metric_rules(spark, report):
    metrics = spark.createDataFrame([m["metrics"] | {"slug": m["slug"]} for m in report["models"]], METRICS)
    unsound = audits.metric_violations(metrics, report["rows"]["test"])
    return unsound.select(F.lit("counts and rates are sound").alias("rule"), F.col("slug").alias("subject"))


def verify_evaluation(spark, report):
    """Checks the report and the predictions it names; all violations are raised together.

    Returns rows and flagged rows of each stored prediction table.
    """
    expected = report["rows"]["test"]
    broken = _expectations(spark, report).where(~F.col("holds")).drop("holds").unionByName(_metric_rules(spark, report))
    audited = {}
    for model in report["models"]:
        score = "anomaly_score" if model["slug"] == settings.FOREST_SLUG else "fraud_probability"
        table = require_columns(readers.read_table(spark, model["predictions"]), (*PREDICTION_COLUMNS, score))
        audit = audits.prediction_audit(table, score)
        wrong = audit.where((F.col("rows") != expected) | (F.col("invalid_rows") > 0))
        broken = broken.unionByName(
            wrong.select(F.lit("stored predictions are complete").alias("rule"), F.lit(model["slug"]).alias("subject"))
        )
        audited[model["slug"]] = audit
    found = [f"{r['subject']}: {r['rule']}" for r in broken.orderBy("subject", "rule").collect()]
    if found:
        raise RuntimeError("evaluation is not sound; these do not hold: " + "; ".join(found))
    kept = ("rows", "flagged_rows")
    return {slug: {k: v for k, v in audit.first().asDict().items() if k in kept} for slug, audit in audited.items()}


def verify_final(spark, predictions, suspicious, prediction_report):
    """New predictions match their report; the suspicious list is short and all for review."""
    table = require_columns(readers.read_table(spark, predictions), NEW_PREDICTION_COLUMNS)
    row = audits.prediction_audit(table).first()
    if row["rows"] != prediction_report["rows"]["scored"] or row["invalid_rows"]:
        raise RuntimeError(f"new predictions are not sound: {row.asDict()}")
    top = audits.suspicious_audit(readers.read_table(spark, suspicious)).first()
    if top["rows"] > settings.SUSPICIOUS_ROWS or top["wrong_status"]:
        raise RuntimeError(f"the suspicious list is not sound: {top.asDict()}")
    return {"new_prediction": row.asDict(), "top_suspicious_rows": top["rows"]}
