"""Batch sources."""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from txrisk import schemas
from txrisk.settings import EVALUATION_REPORT


def read_raw_transactions(spark, path):
    """Header CSV; a cell that does not fit its type becomes null and the row stays."""
    return spark.read.csv(
        path, schema=schemas.RAW_TRANSACTIONS, header=True, mode="PERMISSIVE", encoding="UTF-8"
    )


def read_labels(spark, path):
    """Header CSV of (transaction_id, label); a malformed row fails the job."""
    return spark.read.csv(path, schema=schemas.RAW_LABELS, header=True, mode="FAILFAST")


def read_label_map(spark, path):
    """``{"target": {"<id>": "Yes"|"No", ...}}`` to (transaction_id, label), every pair kept.

    The file is split at commas, so one huge line is still read by many tasks.
    """
    pair = r'"([0-9]+)"\s*:\s*"(Yes|No)"'
    pieces = spark.read.text(path, lineSep=",").where(F.col("value").rlike(pair))
    return pieces.select(
        F.regexp_extract("value", pair, 1).try_cast("bigint").alias("transaction_id"),
        F.regexp_extract("value", pair, 2).alias("label"),
    )


def require_label_pairs(labels):
    """Raises unless there is at least one pair, and at least one Yes; returns the counts."""
    found = labels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("label") == "Yes").alias("yes"),
        F.count_if(F.col("label") == "No").alias("no"),
    ).first()
    if found["total"] == 0 or found["yes"] == 0:
        raise ValueError(f"label map holds {found['total']} pairs, {found['yes']} of them Yes")
    return found.asDict()


def read_new_transactions(spark, path):
    """Header CSV of rows to score, without a label; a malformed row fails the job."""
    return spark.read.csv(path, schema=schemas.NEW_TRANSACTIONS, header=True, mode="FAILFAST")


def read_table(spark, path):
    """Parquet with hive partition discovery."""
    return spark.read.parquet(path)


def read_report(spark, path):
    """A stored JSON report as a dict; an absent or unreadable one gives ``{}``."""
    try:
        texts = [row[0] for row in spark.read.text(path, wholetext=True).where("trim(value) <> ''").take(2)]
        if len(texts) > 1:
            raise ValueError(f"{path} holds more than one report")
        return json.loads(texts[0]) if texts else {}
    except (AnalysisException, json.JSONDecodeError):
        return {}


def read_selection(spark, model_base):
    """Which model and thresholds the last evaluation recommended."""
    return read_report(spark, f"{model_base}/{EVALUATION_REPORT}").get("selection", {})
