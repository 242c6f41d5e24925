"""The recent-alert view over stored alert tables."""

from pyspark.sql import functions as F

from txrisk.operators.reports import latest_alerts
from txrisk.settings import ALERT_FEED_ROWS
from txrisk.sources.publish import names_below, publish, remove


def recent_days(alerts, rows=ALERT_FEED_ROWS):
    """The alerts of the newest days that hold at least ``rows`` of them.

    Counting rows per day reads no column of the files; days before are pruned from the scan.
    """
    found, held = None, 0
    for row in alerts.groupBy("day").count().orderBy(F.desc("day")).toLocalIterator():
        found, held = row["day"], held + row["count"]
        if held >= rows:
            break
    return alerts.where(F.col("day") >= F.lit(found)) if found is not None else alerts


def alert_feed(spark, path, rows=ALERT_FEED_ROWS):
    """The newest alerts of one kind of alert, newest first; only those reach the driver."""
    return latest_alerts(recent_days(spark.read.parquet(path), rows), rows)


def _states(spark, path):
    return sorted(int(name.partition("=")[2]) for name in names_below(spark, path) if name.startswith("batch="))


def keep_newest(alerts, path, number, rows=ALERT_FEED_ROWS, time="detectedAt"):
    """Merges the alerts of micro-batch ``number`` into the feed kept at ``path``.

    The feed is a table of at most ``rows`` alerts, whatever was alerted before. Every batch starts
    from the newest feed of an earlier batch and stores its own by its number, so a batch that is
    run again gives the same feed; the last two are kept. A feed belongs to one checkpoint.
    """
    spark = alerts.sparkSession
    earlier = [n for n in _states(spark, path) if n < number]
    merged = alerts
    if earlier:
        merged = spark.read.schema(alerts.schema).parquet(f"{path}/batch={earlier[-1]}").unionByName(alerts)
    newest = latest_alerts(merged, rows, time)
    publish(spark, f"{path}/batch={number}", lambda name: newest.coalesce(1).write.parquet(name), lambda name: None)
    for n in earlier[:-1]:
        remove(spark, f"{path}/batch={n}")


def kept_feed(spark, path, rows=ALERT_FEED_ROWS, time="detectedAt"):
    """The feed that a stream keeps, newest first: one small file is read."""
    numbers = _states(spark, path)
    if not numbers:
        raise ValueError(f"no feed is kept at {path} yet")
    return latest_alerts(spark.read.parquet(f"{path}/batch={numbers[-1]}"), rows, time)


def feed_status(alerts, rows=ALERT_FEED_ROWS):
    """One row: alerts stored, alerts shown, newest time, amount limit, lowest score alerted."""
    limits = {"threshold": F.max, "anomalyScore": F.min}
    found = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"), F.max("detectedAt").alias("last_alert_at"),
        *(fold(c).alias(c) for c, fold in limits.items() if c in alerts.columns),
    )
    return found.withColumn("shown_alerts", F.least(F.lit(rows), F.col("total_alerts")))


def feed(spark, alert_path, rows=ALERT_FEED_ROWS):
    """Status and newest alerts as one report."""
    status = feed_status(spark.read.parquet(alert_path), rows).first().asDict()
    return {"status": status, "alerts": [row.asDict() for row in alert_feed(spark, alert_path, rows).collect()]}
