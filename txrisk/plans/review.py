"""What a reviewer looks at: suspicious rows of one model, searched, and the numbers above them."""

from txrisk import settings
from txrisk.operators import reports
from txrisk.operators.classifiers import model_spec
from txrisk.sources import readers


def _shown(df):
    return [row.asDict() for row in df.collect()]


def review(spark, prediction_base, model=settings.DEFAULT_MODEL, text="", minimum=0.0,
           rows=settings.ALERT_FEED_ROWS):
    """Summary of the rows for review, and the ``rows`` highest that match text and score."""
    model_spec(model)
    suspicious = reports.needs_review(readers.read_table(spark, f"{prediction_base}/{model}"))
    found = reports.search_suspicious(suspicious, text, minimum)
    return {
        "model": model,
        "summary": _shown(reports.risk_summary(suspicious))[0],
        "rows": _shown(reports.top_suspicious(found, rows)),
    }


def preview(spark, path, rows=10, order="transaction_id"):
    """The first rows of a stored table, in the order of one column."""
    return _shown(reports.first_rows(readers.read_table(spark, path), rows, order))
