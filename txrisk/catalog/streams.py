"""Stream queries: the events table read as a stream, run to its end, and read back."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from txrisk.catalog.registry import query
from txrisk.functions.text import iso_timestamp
from txrisk.operators.isolation_forest import ForestScorer, fit_forest
from txrisk.operators.reports import latest_alerts
from txrisk.session import scratch_path, written
from txrisk.streaming import endpoints, feed, jobs, recovery, rules

ALERT = '"transactionId", "accountId", amount, currency, threshold, status, reason'


def _records(v):
    """The events as a stream of JSON text. The glob takes a single file as well as a folder."""
    schema = v.table("events").schema
    return v.records(endpoints.table_source(v.spark, f"{v.folder}/events.parquet*", schema))


def _run(v, stream, name, *partition_columns):
    """Runs a stream to the end of its source and returns what it stored."""
    out = scratch_path(v.spark, name)
    endpoints.to_table(stream, out, f"{out}-progress", True, *partition_columns).awaitTermination()
    return v.spark.read.parquet(out)


def _rule_job(v):
    base = scratch_path(v.spark, "rule-job")
    jobs.run_high_amount_rule(
        _records(v), f"{base}/alerts", f"{base}/letters", f"{base}/progress", 100.0, once=True
    ).awaitTermination()
    return base


def _forest(v):
    """A forest over the readable events, through the stream's own features."""
    rows = rules.stream_features(rules.parsed(v.event_records))
    keyed = rows.withColumn("transaction_id", F.col("transactionId").cast("bigint"))
    return ForestScorer(written(fit_forest(keyed), "stream-forest"))


@query("str_01_rule_stream", f"SELECT {ALERT} FROM rule_alerts")
def _(v):
    return _run(v, rules.high_amount_alerts(_records(v), 100.0), "rule").drop("detectedAt")


@query("str_02_rule_job_alerts", 'SELECT "transactionId", amount FROM rule_alerts')
def _(v):
    alerts = v.spark.read.parquet(f"{_rule_job(v)}/alerts")
    return alerts.select("transactionId", "amount")


@query(
    "str_03_alert_messages",
    """SELECT "transactionId", amount::VARCHAR AS amount, '100.0' AS threshold, 'HIGH_AMOUNT' AS reason
       FROM rule_alerts""",
)
def _(v):
    stored = _run(v, rules.as_messages(rules.high_amount_alerts(_records(v), 100.0)), "messages")
    return stored.select(
        F.get_json_object("value", "$.transactionId").alias("transactionId"),
        F.get_json_object("value", "$.amount").alias("amount"),
        F.get_json_object("value", "$.threshold").alias("threshold"),
        F.get_json_object("value", "$.reason").alias("reason"),
    )


def _agreement(v, forest, alerts):
    """(transactionId, agrees): whether just the events that a batch pass finds odd have an alert."""
    scored = rules.stream_features(rules.parsed(v.event_records)).withColumn("score", forest.score())
    joined = scored.select("transactionId", "score").join(
        alerts.select("transactionId", F.lit(True).alias("alerted")), "transactionId", "left"
    )
    return joined.select("transactionId", (F.col("alerted").isNotNull() == (F.col("score") > 0)).alias("agrees"))


@query("str_04_anomaly_stream", 'SELECT "transactionId", true AS agrees FROM stream_events')
def _(v):
    forest = _forest(v)
    return _agreement(v, forest, _run(v, rules.anomaly_alerts(_records(v), forest, minimum=0.0), "anomalies"))


@query(
    "str_05_stream_features",
    """SELECT "transactionId", amount, hour(transaction_time)::DOUBLE AS transaction_hour,
              (dayofweek(transaction_time) + 1)::DOUBLE AS transaction_day_of_week,
              month(transaction_time)::DOUBLE AS transaction_month,
              year(transaction_time)::DOUBLE AS transaction_year_numeric,
              (dayofweek(transaction_time) IN (0, 6))::INTEGER::DOUBLE AS is_weekend,
              (event_type = 'view')::INTEGER::DOUBLE AS is_online,
              (event_type = 'click')::INTEGER::DOUBLE AS has_error
       FROM stream_events""",
)
def _(v):
    stored = _run(v, rules.stream_features(rules.parsed(_records(v))), "features")
    return stored.drop("accountId", "occurredAt")


@query("str_06_anomaly_messages", 'SELECT "transactionId", true AS agrees FROM stream_events')
def _(v):
    forest = _forest(v)
    messages = rules.as_messages(rules.anomaly_alerts(v.event_records, forest, minimum=0.0))
    written_ids = messages.select(F.get_json_object("value", "$.transactionId").alias("transactionId"))
    return _agreement(v, forest, written_ids)


@query(
    "str_07_dead_letters",
    """SELECT value, CASE WHEN value = 'not json' THEN 'not a JSON object' ELSE 'no finite amount' END AS cause
       FROM records WHERE NOT contains(value, 'transactionId')""",
)
def _(v):
    return _run(v, rules.dead_letters(_records(v), need_time=True), "letters")


def _inbox(v):
    """(folder of text files holding the events, files a batch may take): four batches or more."""
    path, parts = scratch_path(v.spark, "inbox"), int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, 4)
    v.records(v.table("events").repartition(parts, "event_id")).write.text(path)
    return path, -(-parts // 4)


@query(
    "str_08_recovery",
    'SELECT "transactionId", count(*) AS copies FROM rule_alerts GROUP BY "transactionId"',
)
def _(v):
    """A job that stops after it stored a batch and before it committed it, and is started again."""
    inbox, files = _inbox(v)
    base = scratch_path(v.spark, "recovery")
    progress, at = f"{base}/progress", 2
    store = jobs.to_tables(f"{base}/alerts", f"{base}/letters")
    seen = []

    def stopping(alerts, letters, query, number):
        store(alerts, letters, query, number)
        seen.append(number)
        if number == at and seen.count(at) == 1:
            raise RuntimeError("stopped on purpose")

    def start():
        source = endpoints.text_source(v.spark, inbox, maxFilesPerTrigger=files)
        return jobs.run_rule(source, jobs.amount_rule(100.0), stopping, progress, once=True)

    try:
        start().awaitTermination()
    except StreamingQueryException as error:
        if "stopped on purpose" not in str(error):
            raise
    if recovery.checkpoint_state(v.spark, progress) != (at, at - 1) or recovery.next_batch(v.spark, progress) != at:
        raise RuntimeError("the job did not stop between storing and committing")
    start().awaitTermination()
    if seen[:at + 2] != [*range(at + 1), at] or seen[at + 1:] != list(range(at, seen[-1] + 1)):
        raise RuntimeError(f"the restart did not go on in the middle of the source: {seen}")
    return v.spark.read.parquet(f"{base}/alerts").groupBy("transactionId").agg(F.count(F.lit(1)).alias("copies"))


RECENT = """SELECT "transactionId", amount, threshold FROM (
         SELECT a.*, e.transaction_time FROM rule_alerts a JOIN stream_events e USING ("transactionId"))
       ORDER BY transaction_time DESC, "transactionId" LIMIT 100"""


def _timed_alerts(records):
    """Alerts whose time of detection, which is now, is replaced by the event's, so that SQL can follow."""
    events = rules.high_amounts(rules.parsed(records), 100.0)
    return events.select(
        *rules.rule_alert_fields(100.0, stamp=False), iso_timestamp("transaction_time").alias("detectedAt")
    )


@query("str_09_kept_feed", RECENT)
def _(v):
    """The feed that the stream itself keeps, batch by batch."""
    inbox, files = _inbox(v)
    base = scratch_path(v.spark, "kept-feed")
    source = endpoints.text_source(v.spark, inbox, maxFilesPerTrigger=files)
    endpoints.to_batches(
        _timed_alerts(source), lambda batch, number: feed.keep_newest(batch, f"{base}/feed", number), f"{base}/progress",
        once=True,
    ).awaitTermination()
    return feed.kept_feed(v.spark, f"{base}/feed").select("transactionId", "amount", "threshold")


@query(
    "str_09_recent_alerts",
    RECENT,
)
def _(v):
    timed = _timed_alerts(_records(v))
    stored = _run(v, timed.withColumn("day", F.to_date("detectedAt")), "feed", "day")
    return latest_alerts(feed.recent_days(stored)).select("transactionId", "amount", "threshold")
