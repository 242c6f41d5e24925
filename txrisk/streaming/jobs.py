"""Running the two alert pipelines with their dead letters."""

from pyspark.sql import functions as F

from txrisk.settings import HIGH_AMOUNT_THRESHOLD, MIN_ANOMALY_SCORE
from txrisk.streaming import endpoints, rules

QUERY_ID = "sql.streaming.queryId"


def _each_batch(alerts_of, letters_of, store):
    """Parses a micro-batch once and hands its alerts and letters to ``store``."""
    def write(batch, number):
        query = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        events = rules.parsed(batch).persist()
        try:
            store(alerts_of(events), letters_of(events), query, number)
        finally:
            events.unpersist()

    return write


def to_tables(alert_path, letter_path):
    """Stores both outputs below the query's id and the batch number, alerts by day as well.

    A batch that is run again after a failure overwrites its own folders. A job that starts with
    a new checkpoint has a new id, so it never overwrites what an earlier one left.
    """
    def store(alerts, letters, query, number):
        own = f"query={query}/batch={number}"
        by_day = alerts.withColumn("day", F.to_date("detectedAt"))
        by_day.write.mode("overwrite").partitionBy("day").parquet(f"{alert_path}/{own}")
        letters.write.mode("overwrite").parquet(f"{letter_path}/{own}")

    return store


def _to_topics(servers, alert_topic, letter_topic):
    """Sends both outputs to topics, at least once."""
    def store(alerts, letters, query, number):
        endpoints.send(rules.as_messages(alerts), servers, alert_topic)
        endpoints.send(rules.letter_messages(letters), servers, letter_topic)

    return store


def amount_rule(threshold=HIGH_AMOUNT_THRESHOLD):
    """(alerts of parsed events, letters of parsed events) of the amount rule."""
    return lambda events: rules.high_amount_alerts(events, threshold), rules.dead_letters


def anomaly_rule(scorer, minimum=MIN_ANOMALY_SCORE):
    return (
        lambda events: rules.anomaly_alerts(events, scorer, minimum),
        lambda events: rules.dead_letters(events, need_time=True),
    )


def run_rule(records, rule, store, checkpoint, once=False):
    """Hands the alerts and dead letters of every micro-batch to ``store(alerts, letters, query, number)``.

    The source's position and the batch are planned in the checkpoint before the batch runs and
    committed after it. A batch that stopped between runs again under its number, so a store that
    writes by (query, number) holds it once.
    """
    return endpoints.to_batches(records, _each_batch(*rule, store), checkpoint, once)


def run_to_topics(records, rule, servers, alert_topic, letter_topic, checkpoint, once=False):
    """Alerts and dead letters of a rule to two topics, from one read of the source."""
    return run_rule(records, rule, _to_topics(servers, alert_topic, letter_topic), checkpoint, once)


def run_high_amount_rule(
    records, alert_path, letter_path, checkpoint, threshold=HIGH_AMOUNT_THRESHOLD, once=False
):
    """Amount alerts and unreadable records, from one read of the source."""
    return run_rule(records, amount_rule(threshold), to_tables(alert_path, letter_path), checkpoint, once)


def run_anomaly_rule(
    records, scorer, alert_path, letter_path, checkpoint, minimum=MIN_ANOMALY_SCORE, once=False
):
    """Anomaly alerts and unusable records, from one read of the source."""
    return run_rule(records, anomaly_rule(scorer, minimum), to_tables(alert_path, letter_path), checkpoint, once)
