"""Scoring new, unlabeled transactions with a stored model."""

from txrisk import settings
from txrisk.operators import audits, cleaning, features, reports
from txrisk.operators.classifiers import model_spec
from txrisk.sources import model_store, readers, writers


def choose_model(selection, slug=None, threshold=None):
    """What the caller asked for, else what evaluation recommended, else the defaults."""
    slug = slug or selection.get("recommended_model", settings.DEFAULT_MODEL)
    model_spec(slug)
    if threshold is None:
        threshold = selection.get("thresholds_by_model", {}).get(slug, settings.DEFAULT_THRESHOLD)
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [0, 1]")
    return slug, float(threshold)


def score_new(transactions, preprocessor, model, slug, threshold):
    """Stored prediction layout for parsed new transactions."""
    inputs = preprocessor.transform(features.inference_features(transactions))
    return reports.new_prediction_table(reports.score_rows(model, inputs, threshold), slug, threshold)


def predict(
    spark, input_path, output, model_base, model=None, threshold=None, report=None, export=None
):
    """Validates, scores, stores and reconciles a new file; returns the report."""
    slug, threshold = choose_model(readers.read_selection(spark, model_base), model, threshold)
    parsed = cleaning.parse_new_transactions(readers.read_new_transactions(spark, input_path))
    expected = audits.require_valid_new_transactions(parsed)

    scored = score_new(
        parsed,
        model_store.load_preprocessor(model_base),
        model_store.load_classifier(slug, model_base),
        slug,
        threshold,
    )
    writers.write_table(scored, output)
    stored = readers.read_table(spark, output)
    summary = reports.prediction_summary(stored).first()
    audits.require_rows(summary["rows"], expected, "new predictions")
    if export:
        writers.write_export(reports.ranked_export(stored), export)

    result = {
        "scored_by": {"model": slug, "threshold": threshold},
        "rows": {"scored": expected, "flagged": summary["flagged"], "normal": summary["normal"]},
        "paths": {"read": input_path, "stored": output, "exported": export},
    }
    if report:
        writers.write_report(spark, result, report)
    return result
