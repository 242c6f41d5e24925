"""Prediction layouts, chart tables, top-k lists and search over predictions."""

from pyspark.sql import Window, functions as F

from txrisk.functions.scoring import bin_index, decision, fraud_probability, status
from txrisk.operators.quantiles import exact_quantiles
from txrisk.schemas import NEW_PREDICTION_COLUMNS
from txrisk.settings import ALERT_FEED_ROWS, NEEDS_REVIEW, SUSPICIOUS_ROWS


def score_rows(model, features, threshold, *carry):
    """Model output narrowed to ids, probability and 0/1 decision."""
    return (
        model.transform(features)
        .withColumn("fraud_probability", fraud_probability())
        .withColumn("prediction", decision("fraud_probability", threshold))
        .select(
            "transaction_id", "transaction_time", "amount", *carry, "fraud_probability",
            "prediction",
        )
    )


def prediction_table(scored, model, score="fraud_probability"):
    """The stored layout of evaluated predictions. ``model`` is a name or a column."""
    return scored.select(
        "transaction_id",
        "transaction_time",
        "amount",
        F.col(score).cast("double").alias(score),
        F.col("prediction").cast("int").alias("prediction"),
        status().alias("status"),
        F.col("class").cast("int").alias("actual_class"),
        (F.lit(model) if isinstance(model, str) else model).alias("model"),
    )


def new_prediction_table(scored, slug, threshold):
    """The stored layout of predictions for rows without a label."""
    named = scored.select(
        "*",
        status().alias("status"),
        F.lit(slug).alias("model"),
        F.lit(float(threshold)).alias("threshold"),
    )
    return named.select(*NEW_PREDICTION_COLUMNS)


def quantile_bounds(df, column, low, high):
    """(lower, upper) to clip a histogram at: two exact quantiles."""
    return tuple(exact_quantiles(df, column, (low, high)))


def histogram(df, column, bins, lower, upper):
    """(bin, lower, upper, center, count) with empty bins kept."""
    if bins <= 0 or upper <= lower:
        raise ValueError("a histogram needs bins > 0 and upper > lower")
    width = (upper - lower) / bins
    filled = (
        df.where(F.col(column).between(lower, upper))
        .groupBy(bin_index(column, bins, lower, upper).alias("bin"))
        .agg(F.count(F.lit(1)).alias("found"))
    )
    every_bin = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return every_bin.join(filled, "bin", "left").select(
        "bin",
        (lower + F.col("bin") * width).alias("lower"),
        (lower + (F.col("bin") + 1) * width).alias("upper"),
        (lower + (F.col("bin") + 0.5) * width).alias("center"),
        F.coalesce("found", F.lit(0)).alias("count"),
    )


def clipped_histogram(df, column, bins, low, high):
    """Histogram between two quantiles; the two numbers are looked up first."""
    lower, upper = quantile_bounds(df, column, low, high)
    if lower is None:
        raise ValueError(f"no values in {column} to take bounds from")
    return histogram(df, column, bins, lower, upper)


def flagged(predictions):
    """Needs only the prediction=1 partition where the table is stored by prediction."""
    return predictions.where(F.col("prediction") == 1)


def needs_review(predictions):
    return predictions.where((F.col("status") == NEEDS_REVIEW) | (F.col("prediction") == 1))


def top_suspicious(predictions, rows=SUSPICIOUS_ROWS, score="fraud_probability"):
    return flagged(predictions).orderBy(F.desc(score), F.asc("transaction_id")).limit(rows)


def search_suspicious(suspicious, text="", minimum=0.0, score="fraud_probability"):
    """Rows whose id or time contains the text, whatever its case, at or above a score."""
    shown = F.lower(
        F.concat_ws(" ", F.col("transaction_id").cast("string"), F.col("transaction_time").cast("string"))
    )
    wanted = shown.contains(text.strip().lower())
    return suspicious.where(wanted & (F.coalesce(score, F.lit(0.0)) >= minimum))


def risk_summary(suspicious, score="fraud_probability"):
    return suspicious.agg(
        F.count(F.lit(1)).alias("suspicious"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max_score"),
    )


def ranked_export(predictions, score="fraud_probability"):
    """All rows from most to least suspicious: a range-partitioned sort, written in parallel."""
    return predictions.orderBy(F.desc(score), F.asc("transaction_id"))


def prediction_summary(predictions):
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("prediction") == 1).alias("flagged"),
        F.count_if(~F.col("prediction").eqNullSafe(1)).alias("normal"),
    )


def sorted_importance(importance):
    return importance.orderBy(F.asc("slug"), F.desc("importance"), F.asc("feature"))


def top_features(importance, k=15):
    """The k most important features of each model."""
    order = Window.partitionBy("slug").orderBy(F.desc("importance"), F.asc("feature"))
    ranked = importance.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def first_rows(df, rows, *order):
    return df.orderBy(*order).limit(rows)


def latest_alerts(alerts, rows=ALERT_FEED_ROWS, time="detectedAt"):
    """Newest alerts first."""
    return alerts.orderBy(F.desc(time), F.asc("transactionId")).limit(rows)
