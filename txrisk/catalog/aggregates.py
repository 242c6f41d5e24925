"""Aggregations, rankings, sorts and top-k lists."""

from functools import reduce

from pyspark.sql import Window, functions as F

from txrisk.catalog.registry import query, rounded
from txrisk.catalog.sql import RATES, md5_bucket as md5_sql, md5_place as place_sql, pr_auc, rates, rounded as r, share_bound
from txrisk.functions.hashing import md5_place
from txrisk.operators import audits, keys, metrics, profiling, reports, sampling
from txrisk.operators.categories import category_dictionary
from txrisk.operators.cleaning import valid_transaction
from txrisk.operators.features import preprocessor, training_features
from txrisk.plans.evaluate import choose_thresholds, decide, describe_models, result_tables


RAW = (
    "id", "date", "client_id", "card_id", "amount", "use_chip", "merchant_id", "merchant_city",
    "merchant_state", "zip", "mcc", "errors",
)


def _percent(part, whole):
    return f"round(100.0::DOUBLE * {part} / nullif({whole}, 0), 6)"


# --- profiles ----------------------------------------------------------------


@query(
    "agg_01_raw_profile",
    "SELECT count(*) AS row_count, "
    + ", ".join(
        f"count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS {c}_missing" for c in RAW
    )
    + " FROM raw_tx",
)
def _(v):
    return profiling.raw_profile(v.raw)


@query(
    "agg_02_surplus_duplicates",
    "SELECT count(id) - count(DISTINCT id) AS duplicates FROM raw_tx",
)
def _(v):
    return keys.surplus_duplicates(v.raw, "id")


@query(
    "agg_02_line_duplicates",
    """SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem""",
)
def _(v):
    return keys.surplus_duplicates(v.table("lineitem"), "l_orderkey", "l_linenumber")


@query(
    "agg_02_id_profile",
    """SELECT (SELECT count(id) - count(DISTINCT id) FROM raw_tx) AS duplicates,
              (SELECT count(DISTINCT transaction_id) FROM valid_tx) AS valid_ids""",
)
def _(v):
    return profiling.id_profile(v.raw)


@query("agg_03_one_row_per_key", "SELECT transaction_id, amount, transaction_time FROM clean_tx")
def _(v):
    valid = v.parsed.select("transaction_id", "transaction_time", "amount").where(valid_transaction())
    return keys.keep_one_per_key(valid, "transaction_id")


@query(
    "agg_04_conflicting_labels",
    """SELECT transaction_id, 2 AS class_count FROM line_labels
       GROUP BY transaction_id HAVING count(DISTINCT label) > 1""",
)
def _(v):
    from txrisk.operators.cleaning import label_conflicts

    return label_conflicts(v.line_labels)


@query(
    "agg_05_totals",
    """SELECT 'clean' AS name, count(*) AS rows FROM clean_tx
       UNION ALL SELECT 'labels', count(*) FROM clean_labels
       UNION ALL SELECT 'labeled', count(*) FROM labeled""",
)
def _(v):
    return profiling.table_sizes(v.clean, v.labels)


@query(
    "agg_06_class_distribution",
    f"""SELECT class, count(*) AS count, {_percent('count(*)', 'sum(count(*)) OVER ()')} AS percentage
        FROM labeled GROUP BY class""",
)
def _(v):
    return profiling.class_distribution(v.labeled)


@query(
    "agg_07_raw_label_distribution",
    f"""SELECT label, count(*) AS count, {_percent('count(*)', 'sum(count(*)) OVER ()')} AS percentage
        FROM raw_labels GROUP BY label""",
)
def _(v):
    return profiling.class_distribution(v.raw_labels, "label")


@query(
    "agg_08_amount_statistics",
    """SELECT round(min(amount), 2) AS min, round(max(amount), 2) AS max, round(avg(amount), 4) AS mean,
              round(stddev_samp(amount), 4) AS stddev FROM labeled""",
)
def _(v):
    row = profiling.amount_moments(v.labeled)
    return rounded(rounded(row, "min", "max", digits=2), "mean", "stddev", digits=4)


@query(
    "agg_09_quartiles",
    """SELECT quantile_disc(amount, 0.25) AS q25, quantile_disc(amount, 0.5) AS q50,
              quantile_disc(amount, 0.75) AS q75 FROM labeled""",
)
def _(v):
    return profiling.amount_quartiles(v.labeled)


@query(
    "agg_10_join_coverage",
    f"""SELECT clean_transactions, valid_labels, labeled_transactions,
               clean_transactions - labeled_transactions AS without_label,
               {_percent('labeled_transactions', 'clean_transactions')} AS coverage_percentage
        FROM (SELECT (SELECT count(*) FROM clean_tx) AS clean_transactions,
                     (SELECT count(*) FROM clean_labels) AS valid_labels,
                     (SELECT count(*) FROM labeled) AS labeled_transactions)""",
)
def _(v):
    return profiling.join_coverage(v.clean, v.labels)


@query(
    "agg_11_dropped_rows",
    """SELECT raw_rows, clean_rows, raw_rows - clean_rows AS dropped_rows
       FROM (SELECT (SELECT count(*) FROM raw_tx) AS raw_rows, (SELECT count(*) FROM clean_tx) AS clean_rows)""",
)
def _(v):
    return profiling.dropped_rows(v.raw)


@query(
    "agg_12_split_fractions",
    """SELECT split, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 8) AS fraction
       FROM split_rows GROUP BY split""",
)
def _(v):
    return sampling.split_fractions(v.labeled, md5_place)


@query(
    "agg_13_class_weights",
    """SELECT class, count(*) AS rows, round(sum(count(*)) OVER () / (2 * count(*)), 6) AS weight
       FROM labeled GROUP BY class""",
)
def _(v):
    return rounded(sampling.class_weights(v.labeled), "weight")


# --- evaluation --------------------------------------------------------------


@query("agg_14_confusion_counts", "SELECT slug, tp, tn, fp, fn FROM confusion")
def _(v):
    return metrics.confusion_counts(v.decided())


@query(
    "agg_15_rates",
    f"SELECT slug, tp, tn, fp, fn, evaluation_rows, {r(*RATES)} FROM (SELECT *, {rates()} FROM confusion)",
)
def _(v):
    return rounded(metrics.binary_metrics(v.decided()), *RATES)


@query(
    "agg_16_threshold_sweep",
    f"SELECT slug, threshold, tp, tn, fp, fn, evaluation_rows, {r(*RATES)} FROM sweep",
)
def _(v):
    return rounded(metrics.threshold_sweep(v.scored(), "fraud_probability"), *RATES)


@query("agg_17_area_under_pr", pr_auc("scored", "fraud_probability"))
def _(v):
    return rounded(metrics.area_under_pr(v.scored(), "fraud_probability"), "pr_auc")


@query(
    "agg_18_pr_curve",
    """SELECT slug, score_bucket / 200::DOUBLE AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS precision,
              round(coalesce(tp / nullif(all_positives, 0), 0), 6) AS recall FROM running
       UNION ALL SELECT DISTINCT slug, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM running""",
)
def _(v):
    curve = metrics.pr_curve(v.predictions.withColumnRenamed("model", "slug"), "fraud_probability")
    return rounded(curve, "precision", "recall")


def _histogram_sql(rows, column, bins, lower, upper):
    """lower and upper are SQL expressions over one-row view b."""
    return f"""
        SELECT bin::INTEGER AS bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper,
               round(lo + (bin + 0.5::DOUBLE) * w, 6) AS center, coalesce(found, 0) AS count
        FROM range({bins}) AS t(bin)
        CROSS JOIN (SELECT {lower} AS lo, ({upper} - {lower}) / {bins} AS w FROM {rows})
        LEFT JOIN (
          SELECT least({bins - 1}, floor(({column} - lo) / w)::INTEGER) AS bin, count(*) AS found
          FROM {rows}, (SELECT {lower} AS lo, {upper} AS hi, ({upper} - {lower}) / {bins} AS w FROM {rows})
          WHERE {column} BETWEEN lo AND hi GROUP BY 1) USING (bin)"""


EDGES = ("lower", "upper", "center")


@query(
    "agg_19_histogram",
    _histogram_sql("labeled", "amount", 50, "any_value(0::DOUBLE)", "any_value(500000::DOUBLE)"),
)
def _(v):
    return rounded(reports.histogram(v.labeled, "amount", 50, 0.0, 500000.0), *EDGES)


@query(
    "agg_20_clip_bounds",
    """SELECT 'all' AS part, quantile_disc(amount, 0.01) AS lower, quantile_disc(amount, 0.99) AS upper FROM labeled
       UNION ALL
       SELECT 'fraud', min(amount), quantile_disc(amount, 0.99) FROM labeled WHERE class = 1""",
)
def _(v):
    fraud = v.stored.where(F.col("class") == 1)
    rows = [
        (part, *reports.quantile_bounds(df, "amount", low, 0.99))
        for part, df, low in (("all", v.stored, 0.01), ("fraud", fraud, 0.0))
    ]
    return v.spark.createDataFrame(rows, "part STRING, lower DOUBLE, upper DOUBLE")


@query(
    "agg_21_amount_histogram",
    _histogram_sql("labeled", "amount", 50, "quantile_disc(amount, 0.01)", "quantile_disc(amount, 0.99)"),
)
def _(v):
    return rounded(reports.clipped_histogram(v.stored, "amount", 50, 0.01, 0.99), *EDGES)


@query(
    "agg_21_fraud_amount_histogram",
    _histogram_sql(
        "(SELECT * FROM labeled WHERE class = 1)", "amount", 40, "min(amount)", "quantile_disc(amount, 0.99)"
    ),
)
def _(v):
    fraud = v.stored.where(F.col("class") == 1)
    return rounded(reports.clipped_histogram(fraud, "amount", 40, 0.0, 0.99), *EDGES)


@query(
    "agg_21_probability_histogram",
    _histogram_sql(
        "(SELECT * FROM scored WHERE slug = 'rf_undersampling')", "fraud_probability", 50,
        "any_value(0::DOUBLE)", "any_value(1::DOUBLE)",
    ),
)
def _(v):
    own = v.scored().where(F.col("slug") == "rf_undersampling")
    return rounded(reports.histogram(own, "fraud_probability", 50, 0.0, 1.0), *EDGES)


@query("agg_21_class_counts", "SELECT class, count(*) AS count FROM labeled GROUP BY class")
def _(v):
    return profiling.class_distribution(v.labeled).select("class", "count")


@query(
    "agg_22_prediction_summary",
    """SELECT count(*) AS rows, count(*) FILTER (prediction = 1) AS flagged,
              count(*) FILTER (prediction <> 1) AS normal
       FROM predictions WHERE model = 'rf_undersampling'""",
)
def _(v):
    return reports.prediction_summary(v.predictions.where(F.col("model") == "rf_undersampling"))


@query(
    "agg_23_duplicated_ids",
    """SELECT count(*) AS duplicate_ids FROM (SELECT id FROM raw_tx GROUP BY id HAVING count(*) > 1)""",
)
def _(v):
    return keys.duplicated_keys(v.raw, "id")


@query(
    "agg_23_new_transaction_profile",
    """SELECT sum(n)::BIGINT AS rows, sum(invalid)::BIGINT AS invalid_rows, count(*) FILTER (n > 1) AS duplicate_ids
       FROM (SELECT transaction_id, count(*) AS n,
                    count(*) FILTER (transaction_id IS NULL OR transaction_time IS NULL OR amount IS NULL
                                     OR isnan(amount) OR amount < 0 OR mcc IS NULL) AS invalid
             FROM parsed_tx GROUP BY transaction_id)""",
)
def _(v):
    return audits.new_transaction_profile(v.parsed)


@query(
    "agg_24_prediction_audit",
    """SELECT model, count(*) AS rows,
              count(*) FILTER (transaction_id IS NULL OR transaction_time IS NULL OR fraud_probability IS NULL) AS invalid_rows,
              count(*) FILTER (prediction = 1) AS flagged_rows
       FROM predictions GROUP BY model""",
)
def _(v):
    return audits.prediction_audit(v.predictions, by=("model",))


@query(
    "agg_25_suspicious_audit",
    "SELECT count(*) AS rows, count(*) FILTER (status <> 'NEEDS_REVIEW') AS wrong_status FROM predictions",
)
def _(v):
    return audits.suspicious_audit(v.predictions)


@query(
    "agg_26_metric_violations",
    """SELECT slug, tp + (slug = 'rf_class_weight')::BIGINT AS tp, tn, fp, fn FROM confusion
       WHERE slug IN ('rf_class_weight', 'rf_none', 'lr_none')""",
)
def _(v):
    # One model has a row too many, one a rate above 1, one lacks a rate; the others are sound.
    broken = v.metrics_by_model.withColumns({
        "tp": F.col("tp") + (F.col("slug") == "rf_class_weight").cast("bigint"),
        "precision": F.col("precision") + F.when(F.col("slug") == "rf_none", 2.0).otherwise(0.0),
        "pr_auc": F.when(F.col("slug") != "lr_none", F.col("pr_auc")),
    })
    return audits.metric_violations(broken, v.stored.count()).select("slug", "tp", "tn", "fp", "fn")


@query(
    "agg_27_model_comparison",
    f"""SELECT slug, CASE WHEN slug LIKE 'lr%' THEN 'Logistic Regression' ELSE 'Random Forest' END AS model,
               CASE WHEN slug LIKE '%none' THEN 'None' WHEN slug LIKE '%weight' THEN 'Class Weight'
                    ELSE 'Undersampling' END AS imbalance_method,
               evaluation_rows, {r('precision', 'recall', 'f1', 'accuracy')}, pr_auc
        FROM (SELECT *, {rates()} FROM confusion) JOIN ({pr_auc('decided', 'fraud_probability')}) USING (slug)""",
)
def _(v):
    compared = describe_models(v.metrics_by_model)
    table = result_tables(compared, compared.withColumn("threshold", F.lit(0.5)))["model_comparison"]
    return rounded(table, "precision", "recall", "f1", "accuracy", "pr_auc")


@query(
    "agg_29_overview",
    f"""SELECT raw, clean, labeled, fraud, {_percent('fraud', 'labeled')} AS fraud_rate FROM (
          SELECT (SELECT count(*) FROM raw_tx) AS raw, (SELECT count(*) FROM clean_tx) AS clean,
                 (SELECT count(*) FROM labeled) AS labeled,
                 (SELECT count(*) FROM labeled WHERE class = 1) AS fraud)""",
)
def _(v):
    return profiling.overview(v.raw, v.labeled)


@query(
    "agg_30_risk_summary",
    """SELECT count(*) AS suspicious, coalesce(max(fraud_probability), 0) AS max_score
       FROM predictions WHERE prediction = 1""",
)
def _(v):
    return reports.risk_summary(reports.flagged(v.predictions))


# --- windows and rankings ----------------------------------------------------


@query(
    "win_01_running_counts",
    "SELECT slug, score_bucket, positives, negatives, tp, fp, all_positives FROM running",
)
def _(v):
    long = v.predictions.withColumnRenamed("model", "slug")
    return metrics.running_counts(metrics.score_buckets(long, "fraud_probability"))


@query(
    "win_02_best_threshold",
    f"SELECT slug, threshold, tp, tn, fp, fn, evaluation_rows, {r(*RATES)} FROM chosen",
)
def _(v):
    sweep = metrics.threshold_sweep(v.scored(v.splits["validation"]), "fraud_probability")
    return rounded(metrics.select_thresholds(sweep), *RATES)


@query(
    "win_03_recommended_model",
    """SELECT slug, threshold, round(f1, 6) AS f1, round(v.pr_auc, 6) AS pr_auc
       FROM chosen JOIN validation_auc v USING (slug) ORDER BY v.pr_auc DESC, f1 DESC, precision DESC, slug LIMIT 1""",
)
def _(v):
    selection = choose_thresholds(v.stored_scores(v.splits["validation"]))
    best = metrics.recommend_model(selection).select("slug", "threshold", "f1", "pr_auc")
    return rounded(best, "f1", "pr_auc")


IMPORTANCE_SQL = """
    SELECT p_brand AS slug, p_type AS feature, round(sum(p_retailprice), 2) AS importance FROM part GROUP BY ALL"""


def _importance(v):
    """A table shaped like feature importances: brands for models, types for features."""
    return v.table("part").groupBy(F.col("p_brand").alias("slug"), F.col("p_type").alias("feature")).agg(
        F.round(F.sum("p_retailprice"), 2).alias("importance")
    )


@query(
    "win_04_top_features",
    f"""SELECT slug, feature, importance, rank::INTEGER AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY slug ORDER BY importance DESC, feature) AS rank
          FROM ({IMPORTANCE_SQL})) WHERE rank <= 15""",
)
def _(v):
    return reports.top_features(_importance(v), 15)


@query(
    "win_05_keep_one_line",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                      ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)
       WHERE n = 1""",
)
def _(v):
    lines = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return keys.keep_one_per_key(lines, "l_orderkey", "l_linenumber")


# --- sorts and top-k ---------------------------------------------------------


@query(
    "top_01_top_suspicious",
    """SELECT transaction_id, transaction_time, amount, fraud_probability, status, actual_class, model
       FROM predictions WHERE prediction = 1 AND model = 'rf_undersampling'
       ORDER BY fraud_probability DESC, transaction_id LIMIT 20""",
)
def _(v):
    own = v.predictions.where(F.col("model") == "rf_undersampling")
    return reports.top_suspicious(own).drop("prediction")


@query(
    "top_02_ranked_export",
    "SELECT model, transaction_id, fraud_probability, prediction FROM predictions",
)
def _(v):
    from txrisk.session import scratch_path, written
    from txrisk.sources.writers import write_export

    path = scratch_path(v.spark, "export")
    narrow = v.predictions.select("model", "transaction_id", "fraud_probability", "prediction")
    write_export(reports.ranked_export(written(narrow, "predictions")), path)
    schema = "model STRING, transaction_id BIGINT, fraud_probability DOUBLE, prediction INT"
    return v.spark.read.csv(path, schema=schema, header=True)


@query(
    "top_03_ordered_groups",
    "SELECT transaction_year, class, count(*) AS rows FROM labeled GROUP BY ALL ORDER BY ALL",
)
def _(v):
    groups = v.labeled.groupBy("transaction_year", "class").agg(F.count(F.lit(1)).alias("rows"))
    return groups.orderBy("transaction_year", "class")


@query("top_04_sorted_importance", f"SELECT * FROM ({IMPORTANCE_SQL}) ORDER BY slug, importance DESC, feature")
def _(v):
    return reports.sorted_importance(_importance(v))


@query(
    "top_05_check_sample",
    "SELECT transaction_id, amount FROM labeled ORDER BY transaction_id LIMIT 100",
)
def _(v):
    return reports.first_rows(v.labeled, 100, "transaction_id").select("transaction_id", "amount")


@query(
    "top_06_first_rows",
    """SELECT model, transaction_id, fraud_probability FROM predictions
       ORDER BY transaction_id, model LIMIT 20""",
)
def _(v):
    rows = reports.first_rows(v.predictions, 20, "transaction_id", "model")
    return rows.select("model", "transaction_id", "fraud_probability")


@query(
    "top_07_latest_alerts",
    """SELECT event_id::VARCHAR AS "transactionId", ts AS "detectedAt", value AS amount FROM events
       WHERE value > 50 ORDER BY ts DESC, event_id::VARCHAR LIMIT 100""",
)
def _(v):
    alerts = v.table("events").where("value > 50").select(
        F.col("event_id").cast("string").alias("transactionId"),
        F.col("ts").alias("detectedAt"),
        F.col("value").alias("amount"),
    )
    return reports.latest_alerts(alerts)


# --- sampling ----------------------------------------------------------------


@query(
    "ml_07_two_way_split",
    f"""SELECT {md5_sql('transaction_id', 42)} < 800000 AS first, count(*) AS rows,
               round(sum(amount), 2) AS amount FROM labeled GROUP BY 1""",
)
def _(v):
    parts = sampling.split(v.stored, place=md5_place)
    named = [df.withColumn("first", F.lit(flag)) for df, flag in zip(parts, (True, False))]
    return reduce(lambda a, b: a.unionByName(b), named).groupBy("first").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("amount"), 2).alias("amount")
    )


@query("ml_08_three_way_split", "SELECT split, transaction_id, class FROM split_rows")
def _(v):
    named = [
        df.select(F.lit(name).alias("split"), "transaction_id", "class")
        for name, df in v.splits.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), named)


@query(
    "ml_09_capped_rows",
    f"""SELECT transaction_id, class FROM train_rows, (SELECT count(*) AS total FROM train_rows)
        WHERE {place_sql('transaction_id', 43)} < {share_bound('(total // 3)::DOUBLE / total')}""",
)
def _(v):
    total = v.splits["train"].count()
    capped = sampling.cap_rows(v.splits["train"], total // 3, place=md5_place)
    return capped.select("transaction_id", "class")


@query(
    "ml_10_undersampled_rows",
    f"""SELECT transaction_id, class FROM labeled, (
          SELECT count(*) FILTER (class = 0) AS normal, count(*) FILTER (class = 1) AS fraud FROM labeled)
        WHERE class = 1 OR {place_sql('transaction_id', 44)} < {share_bound('least(1.0::DOUBLE, fraud * 5.0::DOUBLE / normal)')}""",
)
def _(v):
    thinned = sampling.undersample(v.stored, ratio=5.0, place=md5_place)
    return thinned.select("transaction_id", "class")


_EACH = "least(1.0::DOUBLE, 4.0::DOUBLE * 64 / total)"
_SOME = f"least(1.0::DOUBLE, 4.0::DOUBLE * {_EACH})"


@query(
    "ml_24_bounded_sample",
    f"""SELECT tree, transaction_id FROM (
          SELECT tree::INTEGER AS tree, transaction_id, {place_sql('transaction_id', "46:' || tree || '")} AS draw,
                 {_EACH} / {_SOME} AS share
          FROM train_rows, (SELECT count(*) AS total FROM train_rows), range(4) AS t(tree)
          WHERE {place_sql('transaction_id', 46)} < {share_bound(_SOME)})
        WHERE draw < {share_bound('share')}
        QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, transaction_id) <= 64""",
)
def _(v):
    dealt = sampling.tree_rows(v.splits["train"], trees=4, sample_size=64, place=md5_place)
    order = Window.partitionBy("tree").orderBy("draw", "transaction_id")
    return dealt.withColumn("n", F.row_number().over(order)).where("n <= 64").select("tree", "transaction_id")


# --- evaluation compositions -------------------------------------------------


@query(
    "ml_19_evaluate_scored",
    f"""SELECT slug, tp, tn, fp, fn, evaluation_rows, {r(*RATES)}, pr_auc
        FROM (SELECT *, {rates()} FROM confusion) JOIN ({pr_auc('decided', 'fraud_probability')}) USING (slug)""",
)
def _(v):
    return rounded(v.metrics_by_model, *RATES, "pr_auc")


@query(
    "ml_20_threshold_then_test",
    f"""SELECT slug, threshold, tp, tn, fp, fn, evaluation_rows, {r(*RATES)} FROM (
          SELECT *, {rates()} FROM (
            SELECT slug, threshold, count(*) FILTER (class = 1 AND fraud_probability >= threshold) AS tp,
                   count(*) FILTER (class = 0 AND fraud_probability < threshold) AS tn,
                   count(*) FILTER (class = 0 AND fraud_probability >= threshold) AS fp,
                   count(*) FILTER (class = 1 AND fraud_probability < threshold) AS fn
            FROM scored_test JOIN (SELECT slug, threshold FROM chosen) USING (slug) GROUP BY slug, threshold))""",
)
def _(v):
    sweep = metrics.threshold_sweep(v.scored(v.splits["validation"]), "fraud_probability")
    selection = metrics.select_thresholds(sweep).collect()
    chosen = {row["slug"]: row["threshold"] for row in selection}
    decided = decide(v.scored(v.splits["test"]), chosen)
    result = metrics.binary_metrics(decided)
    limits = v.spark.createDataFrame(list(chosen.items()), "slug STRING, threshold DOUBLE")
    return rounded(result.join(limits, "slug"), *RATES)


@query(
    "ml_01_category_index",
    """SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) - 1)::DOUBLE AS index, n
       FROM (SELECT 'use_chip' AS feature, use_chip AS value, count(*) AS n FROM features GROUP BY ALL
             UNION ALL SELECT 'mcc_category', mcc_category, count(*) FROM features GROUP BY ALL
             UNION ALL SELECT 'merchant_state_category', merchant_state_category, count(*) FROM features GROUP BY ALL)""",
)
def _(v):
    found = category_dictionary(training_features(v.stored))
    return found.select("feature", "value", F.col("slot").cast("double").alias("index"), "n")


@query(
    "ml_04_scaled_numbers",
    "SELECT transaction_id, "
    + ", ".join(
        f"round(coalesce({c} / nullif(stddev_samp({c}) OVER (), 0), 0), 6) AS {c}"
        for c in ("amount", "transaction_hour", "transaction_day_of_week", "transaction_month",
                  "transaction_year_numeric", "is_weekend", "is_online", "has_error")
    )
    + " FROM features",
)
def _(v):
    from pyspark.ml.functions import vector_to_array

    from txrisk.settings import NUMERIC_FEATURES

    # The product's preprocessor; the eight numbers come first in its vector.
    rows = training_features(v.stored)
    scaled = preprocessor().fit(rows).transform(rows)
    values = vector_to_array("features")
    return scaled.select(
        "transaction_id",
        *(F.round(values[i], 6).alias(c) for i, c in enumerate(NUMERIC_FEATURES)),
    )
