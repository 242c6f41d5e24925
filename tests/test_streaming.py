import json

import pytest
from pyspark.sql import functions as F

from txrisk.operators.features import numeric_features
from txrisk.operators.isolation_forest import ForestScorer, fit_forest
from txrisk.streaming import endpoints, feed, jobs, rules

GOOD = {
    "transactionId": "t1", "accountId": "a1", "amount": 2000.5, "currency": "EUR", "country": "US",
    "transaction_time": "2019-12-31 13:05:06", "merchant_state": "CA", "mcc": 5411, "errors": None,
}


def lines(*records):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)


def records(spark, *values):
    texts = [(v if isinstance(v, str) else json.dumps(v),) for v in values]
    return spark.createDataFrame(texts, "value STRING")


@pytest.mark.parametrize(
    "change, flagged",
    [
        ({}, True), ({"amount": 1000}, False), ({"amount": 1000.01}, True), ({"amount": "2000.5"}, True),
        ({"amount": "NaN"}, False), ({"amount": "Infinity"}, False), ({"amount": None}, False), ({"amount": -5}, False),
    ],
)
def test_amount_rule(spark, change, flagged):
    assert rules.high_amount_alerts(records(spark, {**GOOD, **change})).count() == int(flagged)


def test_missing_fields_get_defaults_and_bad_json_is_skipped(spark):
    alerts = rules.high_amount_alerts(records(spark, {"amount": 5000}, "nope", '{"amount": 9000', "", "5", "[1]"))
    (alert,) = alerts.collect()
    assert (alert["transactionId"], alert["accountId"], alert["currency"]) == ("unknown", "unknown", "USD")
    assert alert["threshold"] == 1000.0 and alert["status"] == "NEEDS_REVIEW" and alert["reason"] == "HIGH_AMOUNT"
    assert alert["detectedAt"].endswith("Z")


def test_alert_message_is_keyed_json(spark):
    row = rules.as_messages(rules.high_amount_alerts(records(spark, GOOD))).first()
    body = json.loads(row["value"])
    assert row["transactionId"] == "t1" and body["amount"] == 2000.5 and body["currency"] == "EUR"
    assert list(body) == [
        "transactionId", "accountId", "amount", "currency", "threshold", "status", "reason", "detectedAt",
    ]


def test_dead_letters(spark):
    batch = records(spark, GOOD, "nope", "", {**GOOD, "amount": "x"}, {**GOOD, "transaction_time": "soon"})
    assert rules.dead_letters(batch).count() == 2
    causes = sorted(r["cause"] for r in rules.dead_letters(batch, need_time=True).collect())
    assert causes == ["no finite amount", "no readable time", "not a JSON object", "not a JSON object"]


def test_stream_and_batch_features_agree(spark):
    row = rules.stream_features(rules.parsed(records(spark, GOOD))).first()
    batch = spark.createDataFrame(
        [("2019-12-31 13:05:06", 2000.5, "CA", None)], "t STRING, amount DOUBLE, merchant_state STRING, errors STRING"
    ).withColumn("transaction_time", F.to_timestamp("t"))
    expected = numeric_features(batch).first().asDict()
    assert {k: row[k] for k in expected} == expected
    assert row["transaction_day_of_week"] == 3.0


def test_rule_job_survives_a_restart_without_doubling(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = [str(tmp_path / p) for p in ("alerts", "letters", "progress")]

    def run():
        jobs.run_high_amount_rule(endpoints.text_source(spark, str(inbox)), *paths, once=True).awaitTermination()

    (inbox / "1.txt").write_text(lines(GOOD, "nope", {**GOOD, "transactionId": "t2", "amount": 5}))
    run()
    run()
    (inbox / "2.txt").write_text(lines({**GOOD, "transactionId": "t3"}))
    run()
    alerts = spark.read.parquet(paths[0])
    assert sorted(r["transactionId"] for r in alerts.collect()) == ["t1", "t3"]
    assert spark.read.parquet(paths[1]).count() == 1
    assert feed.alert_feed(spark, paths[0], 1).count() == 1
    status = feed.feed_status(alerts, 1).first()
    assert (status["total_alerts"], status["shown_alerts"], status["threshold"]) == (2, 1, 1000.0)


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("alerts", "letters")]
    store = jobs.to_tables(*paths)
    for _ in range(2):
        events = rules.parsed(records(spark, GOOD))
        store(rules.high_amount_alerts(events), rules.dead_letters(events), "own-id", 4)
    assert spark.read.parquet(paths[0]).count() == 1


def test_a_fresh_checkpoint_loses_nothing(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = [str(tmp_path / p) for p in ("alerts", "letters")]
    for run, name in enumerate(("t1", "t2")):
        (inbox / f"{run}.txt").write_text(lines({**GOOD, "transactionId": name}, "nope"))
        source = endpoints.text_source(spark, str(inbox))
        jobs.run_high_amount_rule(source, *paths, str(tmp_path / f"progress{run}"), once=True).awaitTermination()
    alerts = spark.read.parquet(paths[0])
    # The second job reads the first file again, under an id of its own.
    assert sorted(r["transactionId"] for r in alerts.collect()) == ["t1", "t1", "t2"]
    assert alerts.select("query").distinct().count() == 2 and alerts.where("query = 'None'").count() == 0


def test_feed_reads_the_newest_days_only(spark, tmp_path):
    days = spark.range(10).select(
        F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("day"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("id") + 1).cast("string"), 2, "0")).alias("detectedAt"),
        F.col("id").cast("string").alias("transactionId"),
    )
    days.write.partitionBy("day").parquet(str(tmp_path / "a"))
    found = feed.alert_feed(spark, str(tmp_path / "a"), 3)
    assert [r["transactionId"] for r in found.collect()] == ["9", "8", "7"]
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().executedPlan().toString()


def test_kafka_frames(spark):
    """What would go to a topic, without one: key and value as text."""
    messages = rules.as_messages(rules.high_amount_alerts(records(spark, GOOD)))
    letters = rules.letter_messages(rules.dead_letters(records(spark, "nope")))
    assert messages.dtypes == letters.dtypes == [("transactionId", "string"), ("value", "string")]
    row = letters.first()
    assert row["transactionId"] is None and "not a JSON object" in row["value"]


def test_table_sink_is_exactly_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text(lines(GOOD))
    for _ in range(2):
        stream = rules.high_amount_alerts(endpoints.text_source(spark, str(inbox)))
        endpoints.to_table(stream, str(tmp_path / "out"), str(tmp_path / "progress"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_anomaly_job(spark, tmp_path):
    usual = [
        {**GOOD, "transactionId": str(i), "amount": 20 + i % 50, "transaction_time": f"2019-12-31 13:{i % 60:02d}:00"}
        for i in range(600)
    ]
    odd = {**GOOD, "transactionId": "odd", "amount": 90000, "transaction_time": "2003-02-02 03:00:00",
           "merchant_state": None, "errors": "Bad PIN"}
    train = rules.stream_features(rules.parsed(records(spark, *usual))).withColumn(
        "transaction_id", F.col("transactionId").cast("bigint")
    )
    scorer = ForestScorer(fit_forest(train))
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text(lines(*usual[:50], odd, "nope"))
    paths = [str(tmp_path / p) for p in ("alerts", "letters", "progress")]
    jobs.run_anomaly_rule(endpoints.text_source(spark, str(inbox)), scorer, *paths, once=True).awaitTermination()
    alerts = {r["transactionId"]: r for r in spark.read.parquet(paths[0]).collect()}
    assert "odd" in alerts and alerts["odd"]["anomalyScore"] >= 0.05
    assert alerts["odd"]["occurredAt"] == "2003-02-02 03:00:00" and alerts["odd"]["model"] == "Isolation Forest"
    assert all(a["anomalyScore"] <= alerts["odd"]["anomalyScore"] for a in alerts.values())
    assert spark.read.parquet(paths[1]).count() == 1


def test_minimum_score_applies_on_top_of_the_outlier_rule(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.01,), (0.05,), (0.2,)], "anomaly_score DOUBLE")
    assert rules.anomalies(df).count() == 2
    assert rules.anomalies(df, -1.0).count() == 3


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        endpoints.kafka_source(spark, "localhost:9092", "transactions", group="g")


def test_checkpoint_state(spark, tmp_path):
    from txrisk.streaming import recovery

    progress = str(tmp_path / "progress")
    assert recovery.checkpoint_state(spark, progress) == (None, None) and recovery.next_batch(spark, progress) == 0
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.txt").write_text(lines({**GOOD, "transactionId": f"t{i}"}))
    stored = []

    def store(alerts, letters, query, number):
        stored.append((number, sorted(r["transactionId"] for r in alerts.collect())))
        if len(stored) == 2:
            raise RuntimeError("stop")

    def run():
        source = endpoints.text_source(spark, str(inbox), maxFilesPerTrigger=1)
        jobs.run_rule(source, jobs.amount_rule(), store, progress, once=True).awaitTermination()

    with pytest.raises(Exception, match="stop"):
        run()
    assert recovery.checkpoint_state(spark, progress) == (1, 0) and recovery.next_batch(spark, progress) == 1
    run()
    # The batch that was stored but not committed comes again with the same records.
    assert [n for n, _ in stored] == [0, 1, 1, 2] and stored[1] == stored[2]
    assert recovery.checkpoint_state(spark, progress) == (2, 2) and recovery.next_batch(spark, progress) == 3


def test_kept_feed_stays_small_and_repeats(spark, tmp_path):
    path = str(tmp_path / "feed")

    def alerts(*times):
        rows = [(f"t{t}", f"2024-01-{t:02d}T00:00:00Z") for t in times]
        return spark.createDataFrame(rows, "transactionId STRING, detectedAt STRING")

    with pytest.raises(ValueError, match="no feed"):
        feed.kept_feed(spark, path)
    for number, times in enumerate([(5, 1, 9), (7, 2), (), (8, 3)]):
        for _ in range(2):  # a batch that is run again gives the same feed
            feed.keep_newest(alerts(*times), path, number, rows=3)
        assert len(feed._states(spark, path)) <= 2
    assert [r["transactionId"] for r in feed.kept_feed(spark, path, 3).collect()] == ["t9", "t8", "t7"]
    assert spark.read.parquet(f"{path}/batch=3").count() == 3
