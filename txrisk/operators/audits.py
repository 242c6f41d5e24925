"""Checks of stored tables against what they should hold."""

from pyspark.sql import functions as F

from txrisk.operators.cleaning import scorable_transaction
from txrisk.settings import NEEDS_REVIEW


def prediction_audit(predictions, score="fraud_probability", by=()):
    """rows, rows lacking id, time or score, and flagged rows."""
    lacking = (
        F.col("transaction_id").isNull()
        | F.col("transaction_time").isNull()
        | F.col(score).isNull()
    )
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(lacking).alias("invalid_rows"),
        F.count_if(F.col("prediction") == 1).alias("flagged_rows"),
    )


def suspicious_audit(suspicious):
    return suspicious.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status") != NEEDS_REVIEW).alias("wrong_status"),
    )


def metric_violations(metrics, expected_rows):
    """Metric rows whose counts do not add up or whose rates leave [0, 1]."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    rates = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1", "pr_auc", "accuracy")]
    sound = total == expected_rows
    for rate in rates:
        sound = sound & F.coalesce(rate, F.lit(False))
    return metrics.where(~sound)


def missing_times(**frames):
    """(name, missing) rows without a time in each frame."""
    counts = None
    for name, df in frames.items():
        one = df.agg(
            F.lit(name).alias("name"),
            F.count_if(F.col("transaction_time").isNull()).alias("missing"),
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def require_times(**frames):
    missing = missing_times(**frames).agg(F.sum("missing")).first()[0]
    if missing:
        raise ValueError(f"{missing} rows have no transaction_time")


def new_transaction_profile(parsed):
    """One row: rows, rows a model must not score, and repeated ids, from one grouping."""
    per_id = parsed.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~scorable_transaction()).alias("invalid")
    )
    return per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_rows"),
        F.count_if(F.col("rows") > 1).alias("duplicate_ids"),
    )


def require_valid_new_transactions(parsed):
    """Raises on rows a model must not score and on repeated ids; returns the row count."""
    found = new_transaction_profile(parsed).first()
    if found["invalid_rows"]:
        raise ValueError(f"new transactions contain {found['invalid_rows']} invalid rows")
    if found["duplicate_ids"]:
        raise ValueError(f"new transactions contain {found['duplicate_ids']} duplicated ids")
    return found["rows"]


def differences(left, right):
    """Rows of one table that the other lacks, counting copies; empty when they are equal.

    One grouping of both tables: a row counts +1 on the left and -1 on the right, and what is left
    over is repeated as often as it is missing.
    """
    names = left.columns
    both = left.withColumn("__sign", F.lit(1)).unionByName(right.select(*names).withColumn("__sign", F.lit(-1)))
    surplus = both.groupBy(*names).agg(F.sum("__sign").alias("__more")).where(F.col("__more") != 0)
    times = F.explode(F.array_repeat(F.when(F.col("__more") > 0, "left").otherwise("right"), F.abs("__more").cast("int")))
    return surplus.select(*names, times.alias("side"))


def require_rows(path_rows, expected, what):
    if path_rows != expected:
        raise RuntimeError(f"{what}: expected {expected} rows, read back {path_rows}")
