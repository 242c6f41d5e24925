"""Projections, filters, joins, sets and single functions."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from txrisk.catalog.registry import query, rounded
from txrisk.catalog.sql import md5_bucket as md5_sql, md5_place as place_sql, share_bound
from txrisk.catalog.views import FixedModel
from txrisk.functions import alerts, calendar, hashing, scoring, text
from txrisk.operators import audits, cleaning, features, metrics, reports, sampling
from txrisk.plans.predict import score_new
from txrisk.settings import UNKNOWN
from txrisk.streaming import rules
from txrisk.session import scratch_path
from txrisk.sources.buckets import open_bucketed, store_bucketed

CLEAN_COLUMNS = (
    "transaction_id, transaction_time, client_id, card_id, amount, use_chip, merchant_id, "
    "merchant_city, merchant_state, zip, mcc, errors"
)
FEATURES = (
    "amount, transaction_hour, transaction_day_of_week, transaction_month, "
    "transaction_year_numeric, is_weekend, is_online, has_error, use_chip, mcc_category, "
    "merchant_state_category"
)


# --- projections -------------------------------------------------------------


@query("prj_01_clean_transactions", f"SELECT {CLEAN_COLUMNS}, transaction_year FROM clean_tx")
def _(v):
    return v.clean


@query("prj_02_transaction_year", "SELECT transaction_id, transaction_year FROM clean_tx")
def _(v):
    return v.clean.select("transaction_id", "transaction_year")


@query("prj_03_labeled_layout", f"SELECT {CLEAN_COLUMNS}, class, transaction_year FROM labeled")
def _(v):
    return v.labeled


@query("prj_04_feature_columns", f"SELECT transaction_id, {FEATURES} FROM features")
def _(v):
    return v.features.drop("transaction_time", "class")


@query(
    "prj_05_inference_features",
    f"SELECT transaction_id, transaction_time, {FEATURES} FROM features",
)
def _(v):
    return features.inference_features(v.labeled)


@query(
    "prj_06_training_features",
    f"SELECT transaction_id, transaction_time, class, {FEATURES} FROM features",
)
def _(v):
    return features.training_features(v.labeled)


@query(
    "prj_07_prediction_table",
    """SELECT transaction_id, transaction_time, amount, fraud_probability, prediction, status,
              actual_class, model FROM predictions""",
)
def _(v):
    return reports.prediction_table(v.decided(), F.col("slug"))


@query(
    "prj_08_score_rows",
    """SELECT transaction_id, transaction_time, amount, class, fraud_probability,
              (fraud_probability >= 0.3::DOUBLE)::INTEGER AS prediction
       FROM scored WHERE slug = 'rf_undersampling'""",
)
def _(v):
    scored = reports.score_rows(FixedModel("rf_undersampling"), v.features, 0.3, "class")
    return rounded(scored, "fraud_probability")


class _NoPreprocessing:
    @staticmethod
    def transform(rows):
        return rows


@query(
    "prj_09_new_prediction_table",
    """SELECT transaction_id, transaction_time, amount, fraud_probability, prediction, status, model,
              0.5::DOUBLE AS threshold
       FROM predictions WHERE model = 'lr_class_weight'""",
)
def _(v):
    model = FixedModel("lr_class_weight")
    scored = score_new(v.labeled, _NoPreprocessing, model, "lr_class_weight", 0.5)
    return rounded(scored, "fraud_probability")


@query(
    "prj_10_class_weight_column",
    """SELECT transaction_id, class,
              round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY class)), 6) AS class_weight
       FROM labeled""",
)
def _(v):
    weights = {row["class"]: row["weight"] for row in sampling.class_weights(v.stored).collect()}
    weighted = sampling.with_class_weight(v.stored, weights[0], weights[1])
    return rounded(weighted.select("transaction_id", "class", "class_weight"), "class_weight")


@query(
    "prj_11_confusion_matrix",
    """SELECT class AS actual, prediction AS predicted, count(*) AS count
       FROM decided WHERE slug = 'rf_class_weight' GROUP BY ALL""",
)
def _(v):
    cells = metrics.confusion_matrix(metrics.confusion_counts(v.decided()), "rf_class_weight")
    return cells.where("count > 0")


# --- filters -----------------------------------------------------------------


@query(
    "flt_01_missing_cells",
    """SELECT id, use_chip IS NULL OR trim(use_chip) = '' AS chip_missing,
              merchant_city IS NULL OR trim(merchant_city) = '' AS city_missing,
              errors IS NULL OR trim(errors) = '' AS errors_missing FROM raw_tx""",
)
def _(v):
    return v.raw.select(
        "id",
        text.is_missing("use_chip").alias("chip_missing"),
        text.is_missing("merchant_city").alias("city_missing"),
        text.is_missing("errors").alias("errors_missing"),
    )


@query("flt_02_valid_transactions", "SELECT transaction_id, transaction_time, amount FROM valid_tx")
def _(v):
    valid = v.parsed.where(cleaning.valid_transaction())
    return valid.select("transaction_id", "transaction_time", "amount")


@query("flt_03_usable_labels", "SELECT transaction_id, class FROM parsed_labels")
def _(v):
    return cleaning.parse_labels(v.raw_labels)


@query(
    "flt_04_rejected_new_transactions",
    """SELECT transaction_id, transaction_time, CASE WHEN isnan(amount) THEN NULL ELSE amount END AS amount, mcc
       FROM parsed_tx WHERE transaction_id IS NULL OR transaction_time IS NULL OR amount IS NULL
         OR isnan(amount) OR amount < 0 OR mcc IS NULL""",
)
def _(v):
    rejected = cleaning.rejected_new_transactions(v.parsed)
    return rejected.select(
        "transaction_id", "transaction_time", F.when(~F.isnan("amount"), F.col("amount")).alias("amount"), "mcc",
    )


@query(
    "flt_05_hash_bucket_filter",
    f"SELECT transaction_id, amount FROM clean_tx WHERE {md5_sql('transaction_id', 43)} < 250000",
)
def _(v):
    kept = v.clean.where(hashing.md5_bucket("transaction_id", 43) < 250000)
    return kept.select("transaction_id", "amount")


@query("flt_06_range_filter", "SELECT transaction_id, amount FROM labeled WHERE amount BETWEEN 20000 AND 300000")
def _(v):
    return v.labeled.where(F.col("amount").between(20000, 300000)).select("transaction_id", "amount")


@query(
    "flt_07_flagged_rows",
    "SELECT model, transaction_id, fraud_probability FROM predictions WHERE prediction = 1",
)
def _(v):
    return reports.flagged(v.predictions).select("model", "transaction_id", "fraud_probability")


@query("flt_08_fraud_rows", "SELECT transaction_id, amount, class FROM labeled WHERE class = 1")
def _(v):
    return v.labeled.where(F.col("class") == 1).select("transaction_id", "amount", "class")


@query("flt_09_high_amounts", 'SELECT "transactionId", amount FROM rule_alerts')
def _(v):
    high = rules.high_amounts(rules.parsed(v.event_records), 100.0)
    return high.select("transactionId", F.col("number").alias("amount"))


@query(
    "flt_10_anomaly_rule",
    """SELECT slug, transaction_id, round(fraud_probability - 0.5::DOUBLE, 6) AS anomaly_score FROM scored
       WHERE round(fraud_probability - 0.5::DOUBLE, 6) >= 0.05::DOUBLE""",
)
def _(v):
    score = F.round(F.col("fraud_probability") - 0.5, 6).alias("anomaly_score")
    return rules.anomalies(v.scored().select("slug", "transaction_id", score))


@query(
    "flt_11_missing_times",
    """SELECT name, missing FROM (
         SELECT 'validation' AS name, count(*) FILTER (transaction_time IS NULL) AS missing FROM validation_rows
         UNION ALL SELECT 'raw', count(*) FILTER (transaction_time IS NULL) FROM parsed_tx)""",
)
def _(v):
    return audits.missing_times(validation=v.splits["validation"], raw=v.parsed)


@query(
    "flt_12_search_suspicious",
    """SELECT model, transaction_id, fraud_probability FROM predictions
       WHERE contains(lower(transaction_id || ' ' || strftime(transaction_time, '%Y-%m-%d %H:%M:%S')), '1998-1')
         AND fraud_probability >= 0.2::DOUBLE""",
)
def _(v):
    found = reports.search_suspicious(v.predictions, " 1998-1 ", 0.2)
    return found.select("model", "transaction_id", "fraud_probability")


@query(
    "flt_13_needs_review",
    """SELECT model, transaction_id, status FROM predictions
       WHERE status = 'NEEDS_REVIEW' OR prediction = 1""",
)
def _(v):
    return reports.needs_review(v.predictions).select("model", "transaction_id", "status")


@query("flt_14_one_model", "SELECT slug, tp, tn, fp, fn FROM confusion WHERE slug = 'rf_none'")
def _(v):
    return metrics.confusion_counts(v.decided()).where(F.col("slug") == "rf_none")


# --- joins and sets ----------------------------------------------------------


@query("join_01_label_transactions", "SELECT transaction_id, amount, class FROM labeled")
def _(v):
    return v.clean.join(v.labels, "transaction_id", "inner").select("transaction_id", "amount", "class")


@query("join_01_bucketed_tables", "SELECT transaction_id, amount, class FROM labeled")
def _(v):
    """The same from tables stored in buckets by id, opened as a later session would."""
    buckets = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for name, df in (("clean", v.clean), ("labels", v.labels)):
        path = scratch_path(v.spark, f"bucketed-{name}")
        table = store_bucketed(df, path, "transaction_id", buckets)
        sides.append(open_bucketed(v.spark, path, table.schema, "transaction_id", buckets))
    return sides[0].join(sides[1], "transaction_id").select("transaction_id", "amount", "class")


@query(
    "join_02_unlabeled_transactions",
    """SELECT transaction_id, amount FROM clean_tx
       WHERE transaction_id NOT IN (SELECT transaction_id FROM clean_labels)""",
)
def _(v):
    return cleaning.unlabeled_transactions(v.clean, v.labels).select("transaction_id", "amount")


@query(
    "join_01_document_labels",
    """SELECT d.doc_id, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)""",
)
def _(v):
    documents, labels = v.table("documents"), v.table("labels")
    return documents.join(labels, "doc_id").select("doc_id", "lang", "toxic")


@query(
    "set_01_undersampled_union",
    f"""SELECT transaction_id, class FROM train_rows WHERE class = 1
        UNION ALL
        SELECT transaction_id, class FROM train_rows, (
          SELECT count(*) FILTER (class = 0) AS normal, count(*) FILTER (class = 1) AS fraud FROM train_rows)
        WHERE class = 0 AND {place_sql('transaction_id', 44)} < {share_bound('least(1.0::DOUBLE, fraud * 10.0::DOUBLE / normal)')}""",
)
def _(v):
    return sampling.undersample(v.splits["train"], place=hashing.md5_place).select("transaction_id", "class")


@query(
    "set_02_stacked_metrics",
    """SELECT 'validation' AS part, slug, count(*) AS rows FROM scored_validation GROUP BY slug
       UNION ALL SELECT 'test', slug, count(*) FROM scored_test GROUP BY slug""",
)
def _(v):
    parts = [
        v.scored(v.splits[name]).groupBy("slug").agg(
            F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows")
        )
        for name in ("validation", "test")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "set_03_table_differences",
    """SELECT transaction_id, client_id, 'left' AS side FROM (
         SELECT transaction_id, client_id FROM parsed_tx EXCEPT ALL SELECT transaction_id, client_id FROM clean_tx)
       UNION ALL
       SELECT transaction_id, client_id, 'right' AS side FROM (
         SELECT transaction_id, client_id FROM clean_tx EXCEPT ALL SELECT transaction_id, client_id FROM parsed_tx)""",
)
def _(v):
    columns = ("transaction_id", "client_id")
    return audits.differences(v.parsed.select(*columns), v.clean.select(*columns))


# --- functions ---------------------------------------------------------------


@query(
    "fn_01_money",
    """SELECT id, isnan(a) AS not_a_number, CASE WHEN isnan(a) THEN NULL ELSE a END AS amount FROM (
         SELECT id, TRY_CAST(regexp_replace(trim(amount), '[$,]', '', 'g') AS DOUBLE) AS a FROM raw_tx)""",
)
def _(v):
    amount = v.raw.select("id", text.money("amount").alias("amount"))
    return amount.select(
        "id",
        F.when(F.col("amount").isNotNull(), F.isnan("amount")).alias("not_a_number"),
        F.when(~F.isnan("amount"), F.col("amount")).alias("amount"),
    )


@query(
    "fn_02_timestamp",
    "SELECT id, try_strptime(trim(date), '%Y-%m-%d %H:%M:%S') AS time FROM raw_tx",
)
def _(v):
    return v.raw.select("id", text.timestamp("date").alias("time"))


@query(
    "fn_03_zip_code",
    r"SELECT id, regexp_replace(nullif(trim(zip), ''), '\.0$', '') AS zip FROM raw_tx",
)
def _(v):
    return v.raw.select("id", text.zip_code("zip").alias("zip"))


@query(
    "fn_04_text_or_default",
    "SELECT id, coalesce(nullif(trim(use_chip), ''), 'Unknown') AS use_chip FROM raw_tx",
)
def _(v):
    return v.raw.select("id", text.text_or("use_chip", UNKNOWN).alias("use_chip"))


@query(
    "fn_05_text_or_null",
    """SELECT id, nullif(trim(merchant_city), '') AS city, nullif(trim(merchant_state), '') AS state,
              nullif(trim(errors), '') AS errors FROM raw_tx""",
)
def _(v):
    return v.raw.select(
        "id",
        text.text_or_null("merchant_city").alias("city"),
        text.text_or_null("merchant_state").alias("state"),
        text.text_or_null("errors").alias("errors"),
    )


@query(
    "fn_06_label_class",
    """SELECT transaction_id, label, CASE upper(trim(label)) WHEN 'YES' THEN 1 WHEN 'NO' THEN 0 END AS class
       FROM raw_labels""",
)
def _(v):
    return v.raw_labels.select("transaction_id", "label", text.label_class("label").alias("class"))


@query("fn_07_mcc_category", "SELECT id, coalesce(mcc::VARCHAR, 'Unknown') AS mcc_category FROM raw_tx")
def _(v):
    return v.raw.select("id", text.mcc_category().alias("mcc_category"))


@query(
    "fn_08_state_category",
    "SELECT id, coalesce(nullif(trim(merchant_state), ''), 'ONLINE_OR_UNKNOWN') AS state FROM raw_tx",
)
def _(v):
    return v.raw.select("id", text.state_category().alias("state"))


@query(
    "fn_09_hour_month_year",
    """SELECT event_id, hour(ts)::DOUBLE AS hour, month(ts)::DOUBLE AS month, year(ts)::DOUBLE AS year
       FROM events""",
)
def _(v):
    return v.table("events").select(
        "event_id", calendar.hour("ts").alias("hour"), calendar.month("ts").alias("month"),
        calendar.year("ts").alias("year"),
    )


@query("fn_10_day_of_week", "SELECT event_id, (dayofweek(ts) + 1)::DOUBLE AS day FROM events")
def _(v):
    return v.table("events").select("event_id", calendar.day_of_week("ts").alias("day"))


@query(
    "fn_11_weekend_flag",
    "SELECT event_id, (dayofweek(ts) IN (0, 6))::INTEGER::DOUBLE AS weekend FROM events",
)
def _(v):
    return v.table("events").select("event_id", calendar.is_weekend("ts").alias("weekend"))


@query(
    "fn_12_online_flag",
    "SELECT id, (nullif(trim(merchant_state), '') IS NULL)::INTEGER::DOUBLE AS is_online FROM raw_tx",
)
def _(v):
    return v.raw.select("id", calendar.flag(text.is_missing("merchant_state")).alias("is_online"))


@query(
    "fn_13_error_flag",
    "SELECT id, (nullif(trim(errors), '') IS NOT NULL)::INTEGER::DOUBLE AS has_error FROM raw_tx",
)
def _(v):
    return v.raw.select("id", calendar.flag(~text.is_missing("errors")).alias("has_error"))


@query(
    "fn_14_usable_amount",
    """SELECT transaction_id, coalesce(NOT isnan(amount) AND amount >= 0, false) AS usable,
              coalesce(isfinite(amount), false) AS finite FROM parsed_tx""",
)
def _(v):
    return v.parsed.select(
        "transaction_id",
        cleaning.usable_amount().alias("usable"),
        alerts.number("amount").isNotNull().alias("finite"),
    )


@query(
    "fn_15_hash_bucket",
    f"SELECT transaction_id, {md5_sql('transaction_id', 42)}::BIGINT AS bucket FROM clean_tx",
)
def _(v):
    return v.clean.select(
        "transaction_id", hashing.md5_bucket("transaction_id", 42).alias("bucket")
    )


@query(
    "fn_16_bin_index",
    """SELECT slug, transaction_id, least(49, floor(fraud_probability / 0.02::DOUBLE)::INTEGER) AS bin
       FROM scored""",
)
def _(v):
    return v.scored().select(
        "slug", "transaction_id", scoring.bin_index("fraud_probability", 50, 0.0, 1.0).alias("bin")
    )


@query("fn_17_fraud_probability", "SELECT slug, transaction_id, fraud_probability AS p FROM scored")
def _(v):
    p = F.col("fraud_probability")
    vectors = v.scored().withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
    return vectors.select("slug", "transaction_id", scoring.fraud_probability().alias("p"))


@query(
    "fn_18_decision",
    """SELECT slug, transaction_id, (fraud_probability >= 0.2::DOUBLE)::INTEGER AS prediction
       FROM scored""",
)
def _(v):
    return v.scored().select(
        "slug", "transaction_id", scoring.decision("fraud_probability", 0.2).alias("prediction")
    )


@query("fn_19_status_text", "SELECT model, transaction_id, status FROM predictions")
def _(v):
    return v.decided().select(
        F.col("slug").alias("model"), "transaction_id", scoring.status().alias("status")
    )


@query(
    "fn_20_json_fields",
    """SELECT coalesce(json_extract_string(j, '$.transactionId'), 'unknown') AS id,
              coalesce(json_extract_string(j, '$.accountId'), 'unknown') AS account,
              coalesce(json_extract_string(j, '$.currency'), 'USD') AS currency,
              TRY_CAST(json_extract_string(j, '$.amount') AS DOUBLE) AS amount
       FROM (SELECT CASE WHEN json_valid(value) THEN value END AS j FROM records)""",
)
def _(v):
    return rules.parsed(v.event_records).select(
        alerts.text_field("transactionId", "unknown").alias("id"),
        alerts.text_field("accountId", "unknown").alias("account"),
        alerts.text_field("currency", "USD").alias("currency"),
        F.col("number").alias("amount"),
    )


@query(
    "fn_21_iso_timestamp",
    """SELECT event_id, date_trunc('second', ts) AS with_zone, date_trunc('second', ts) AS with_offset,
              date_trunc('day', ts) AS date_only FROM events""",
)
def _(v):
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return v.table("events").select(
        "event_id",
        text.iso_timestamp(F.concat(second, F.lit("Z"))).alias("with_zone"),
        text.iso_timestamp(F.concat(second, F.lit("+07:00"))).alias("with_offset"),
        text.iso_timestamp(F.date_format("ts", "yyyy-MM-dd")).alias("date_only"),
    )


@query(
    "fn_22_detected_at",
    """SELECT event_id, true AS is_now, left(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z' AS stamp FROM events""",
)
def _(v):
    age = F.unix_timestamp() - F.unix_timestamp(F.to_timestamp(alerts.detected_at()))
    return v.table("events").select(
        "event_id", age.between(-60, 60).alias("is_now"), alerts.detected_at(F.col("ts")).alias("stamp")
    )


@query(
    "fn_23_alert_json",
    """SELECT "transactionId", '{"transactionId":"' || "transactionId" || '","accountId":"' || "accountId"
              || '","amount":' || amount || ',"currency":"USD","threshold":100.0,"status":"NEEDS_REVIEW","reason":"HIGH_AMOUNT"}' AS value
       FROM rule_alerts""",
)
def _(v):
    return rules.as_messages(rules.high_amount_alerts(v.event_records, 100.0, stamp=False))


@query(
    "fn_24_percentage",
    """SELECT o_orderpriority, o_orderstatus,
              round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share
       FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def _(v):
    from pyspark.sql import Window

    rows = v.table("orders").groupBy("o_orderpriority", "o_orderstatus").count()
    whole = F.sum("count").over(Window.partitionBy("o_orderpriority"))
    return rows.select(
        "o_orderpriority", "o_orderstatus", scoring.percentage(F.col("count"), whole).alias("share")
    )
