"""From JSON records to alerts: the amount rule and the anomaly rule.

All functions work on streaming and on batch frames with a text column ``value``.
"""

from pyspark.sql import functions as F

from txrisk.functions import alerts, text
from txrisk.operators.features import numeric_features
from txrisk.settings import HIGH_AMOUNT_THRESHOLD, MIN_ANOMALY_SCORE, NEEDS_REVIEW


def parsed(records):
    """Record text and its fields, parsed once. ``readable`` is false unless it is an object.

    What was parsed before is given back as it is, so every rule takes either.
    """
    if "readable" in records.columns:
        return records
    events = records.select("value", alerts.parse_event().alias("event"))
    readable = F.col("event").isNotNull() & F.col("event._corrupt_record").isNull()
    fields = events.select("value", readable.alias("readable"), "event.*")
    return fields.withColumn("number", F.when(F.col("readable"), alerts.number("amount")))


def high_amounts(events, threshold=HIGH_AMOUNT_THRESHOLD):
    """Finite amounts strictly above the threshold."""
    return events.where(F.col("number") > float(threshold))


def rule_alert_fields(threshold=HIGH_AMOUNT_THRESHOLD, stamp=True):
    fields = [
        alerts.text_field("transactionId", "unknown").alias("transactionId"),
        alerts.text_field("accountId", "unknown").alias("accountId"),
        F.col("number").alias("amount"),
        alerts.text_field("currency", "USD").alias("currency"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(NEEDS_REVIEW).alias("status"),
        F.lit("HIGH_AMOUNT").alias("reason"),
    ]
    return [*fields, alerts.detected_at().alias("detectedAt")] if stamp else fields


def high_amount_alerts(records, threshold=HIGH_AMOUNT_THRESHOLD, stamp=True):
    """Alert columns for records over the amount threshold; anything unreadable yields none."""
    return high_amounts(parsed(records), threshold).select(*rule_alert_fields(threshold, stamp))


def as_messages(alert_rows):
    """(transactionId, value): alerts as JSON text with the id to key them by."""
    return alert_rows.select("transactionId", alerts.as_json(*alert_rows.columns).alias("value"))


def scorable(events):
    """Events with a finite amount and a readable time, in transaction columns."""
    timed = events.withColumn("event_time", text.iso_timestamp("transaction_time"))
    return timed.where(F.col("number").isNotNull() & F.col("event_time").isNotNull())


def stream_features(events):
    """The same eight numbers batch scoring uses, next to the alert fields."""
    rows = scorable(events).select(
        alerts.text_field("transactionId", "unknown").alias("transactionId"),
        alerts.text_field("accountId", "unknown").alias("accountId"),
        F.col("transaction_time").alias("occurredAt"),
        F.col("event_time").alias("transaction_time"),
        F.col("number").alias("amount"),
        "merchant_state",
        "errors",
    )
    return numeric_features(rows, "transactionId", "accountId", "occurredAt")


def anomalies(scored, minimum=MIN_ANOMALY_SCORE):
    """Outliers whose score also reaches the minimum worth an alert."""
    return scored.where((F.col("anomaly_score") > 0) & (F.col("anomaly_score") >= float(minimum)))


def anomaly_alerts(records, scorer, minimum=MIN_ANOMALY_SCORE, stamp=True):
    """Alert columns for records the forest finds odd enough."""
    scored = stream_features(parsed(records)).withColumn("anomaly_score", scorer.score())
    fields = [
        "transactionId",
        "accountId",
        "amount",
        F.col("anomaly_score").alias("anomalyScore"),
        F.lit(NEEDS_REVIEW).alias("status"),
        F.lit("ISOLATION_FOREST_ANOMALY").alias("reason"),
        F.lit("Isolation Forest").alias("model"),
        "occurredAt",
    ]
    if stamp:
        fields.append(alerts.detected_at().alias("detectedAt"))
    return anomalies(scored, minimum).select(*fields)


def dead_letters(records, need_time=False):
    """Records that cannot be used: no JSON object, or (for scoring) no usable amount or time."""
    events = parsed(records)
    cause = F.when(~F.col("readable"), "not a JSON object")
    if need_time:
        cause = cause.when(F.col("number").isNull(), "no finite amount").when(
            text.iso_timestamp("transaction_time").isNull(), "no readable time"
        )
    return events.select("value", cause.alias("cause")).where(F.col("cause").isNotNull())


def letter_messages(letters):
    """(transactionId, value): dead letters as JSON text; they have no id to be keyed by."""
    return letters.select(
        F.lit(None).cast("string").alias("transactionId"), alerts.as_json("value", "cause").alias("value")
    )
