"""Raw files to the clean and the labeled Parquet tables."""

from txrisk.operators import cleaning, profiling
from txrisk.session import written
from txrisk.sources import readers, writers


def prepare(
    spark, transactions, labels, output, labeled_output, report=None, label_format="csv"
):
    """Profiles, cleans, labels, writes and reconciles; returns the report.

    ``label_format`` is ``csv`` for (transaction_id, label) rows or ``json`` for the id map.

    The clean table is read back before the join: a lost executor then costs a re-read, not a
    re-run of the cleaning, and nothing is held in executor storage.
    """
    raw = readers.read_raw_transactions(spark, transactions)
    if label_format == "json":
        raw_labels = readers.read_label_map(spark, labels)
        readers.require_label_pairs(raw_labels)
    else:
        raw_labels = readers.read_labels(spark, labels)
    cleaning.require_consistent_labels(raw_labels)
    # Read again for the coverage and the join, so stored: one small row per labeled id.
    known = written(cleaning.clean_labels(raw_labels), "clean-labels")

    raw_profile = profiling.raw_profile(raw).first().asDict()
    ids = profiling.id_profile(raw).first()

    writers.write_table(
        cleaning.clean_transactions(raw), output, "transaction_year", rebalance=True
    )
    clean = writers.reconcile(spark, output, ids["valid_ids"], "clean transactions")

    coverage = profiling.join_coverage(clean, known).first().asDict()
    writers.write_table(
        cleaning.label_transactions(clean, known), labeled_output, "transaction_year", rebalance=True
    )
    labeled = writers.reconcile(
        spark, labeled_output, coverage["labeled_transactions"], "labeled transactions"
    )

    missing = raw_profile.copy()
    raw_rows = missing.pop("row_count")
    result = {
        "tables": {
            "raw": {"rows": raw_rows, "columns": len(raw.columns), "repeated_ids": ids["duplicates"]},
            "clean": {
                "rows": coverage["clean_transactions"], "columns": len(clean.columns), "path": output,
                "left_out": raw_rows - coverage["clean_transactions"],
            },
            "labels": {"rows": coverage["valid_labels"]},
            "labeled": {
                "rows": coverage["labeled_transactions"], "columns": len(labeled.columns), "path": labeled_output,
                "coverage": coverage["coverage_percentage"],
            },
        },
        "missing_cells": {name.removesuffix("_missing"): n for name, n in missing.items()},
        "classes": [row.asDict() for row in profiling.class_distribution(labeled).collect()],
        "amounts": profiling.amount_statistics(labeled).first().asDict(),
    }
    if report:
        writers.write_report(spark, result, report)
    return result
