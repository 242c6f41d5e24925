"""The views of :mod:`txrisk.catalog.views` as SQL, for checking against another engine."""

import re

from txrisk.catalog.views import FIXED_MODELS
from txrisk.settings import CATEGORICAL_FEATURES, NUMERIC_FEATURES, THRESHOLDS


def md5_bucket(key, seed):
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::UBIGINT % 1000000)"


def md5_place(key, seed):
    """Bucket and place inside it; ``seed`` may hold SQL that goes on with the text."""
    fine = f"('0x' || substr(md5({key} || ':{seed}'), 9, 10))::HUGEINT"
    return f"({md5_bucket(key, seed)}::HUGEINT * 1099511627776 + {fine})"


def share_bound(share):
    return f"floor(({share})::DOUBLE * 1099511627776000000.0)"


def doubles(values):
    return ", ".join(f"({v!r}::DOUBLE)" for v in values)


RATES = ("precision", "recall", "f1", "specificity", "accuracy")


def rates():
    """Rates of counts tp, tn, fp, fn; a rate over nothing is 0."""
    return """
        (tp + tn + fp + fn)::BIGINT AS evaluation_rows,
        coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
        coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
        coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
        coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy"""


def rounded(*columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def counts(label, prediction):
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return ", ".join(
        f"count(*) FILTER ({label} = {a} AND {prediction} = {p}) AS {name}"
        for name, (a, p) in cells.items()
    )


def pr_auc(source, score, digits=6):
    """Exact area under the precision-recall curve per slug, from distinct scores."""
    return f"""
        SELECT slug, round(coalesce(sum(strip), 0), {digits}) AS pr_auc FROM (
          SELECT slug, pos / nullif(positives, 0)
                 * (tp / (tp + fp) + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), tp / (tp + fp))) / 2 AS strip
          FROM (
            SELECT slug, pos, neg, sum(pos) OVER (PARTITION BY slug) AS positives,
                   sum(pos) OVER (PARTITION BY slug ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING) AS tp,
                   sum(neg) OVER (PARTITION BY slug ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING) AS fp
            FROM (SELECT slug, {score}, count(*) FILTER (class = 1)::DOUBLE AS pos,
                         count(*) FILTER (class = 0)::DOUBLE AS neg FROM {source} GROUP BY ALL)))
        GROUP BY slug"""


def _blank_to_null(c):
    return f"nullif(trim({c}), '')"


_models = ", ".join(
    f"('{slug}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for slug, (a, b, c) in FIXED_MODELS.items()
)
_copy_order = ", ".join(
    f"{c} NULLS FIRST"
    for c in (
        "transaction_time", "client_id", "card_id", "amount", "use_chip", "merchant_id",
        "merchant_city", "merchant_state", "zip", "mcc", "errors",
    )
)


def _scored(rows):
    return f"""
        SELECT slug, transaction_id, transaction_time, amount, class,
               round(1 / (1 + exp(-(a + b * amount / 100000::DOUBLE + c * hour(transaction_time)))), 6) AS fraud_probability
        FROM {rows} CROSS JOIN (VALUES {_models}) AS m(slug, a, b, c)"""


CTES = {
    "raw_base": """
        SELECT *, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS ts,
               unnest(CASE WHEN o_orderstatus = 'P' THEN [0, 1] ELSE [0] END) AS copy
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "raw_text": """
        SELECT *, format('{:,.2f}', o_totalprice - copy) AS price,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS time
        FROM raw_base""",
    "raw_tx": """
        SELECT CASE WHEN o_totalprice > 499000 THEN NULL ELSE o_orderkey END AS id,
               CASE WHEN day(o_orderdate) = 31 THEN substr(time, 1, 8) || '99' || substr(time, 11)
                    WHEN o_orderstatus = 'O' THEN '  ' || time || ' ' ELSE time END AS date,
               o_custkey AS client_id,
               o_custkey * 100 + c_nationkey AS card_id,
               CASE WHEN copy = 1 THEN replace(price, ',', '')
                    WHEN o_totalprice < 4000 THEN 'abc'
                    WHEN o_totalprice < 7000 THEN 'NaN'
                    WHEN o_totalprice < 10000 THEN '$-' || price
                    WHEN o_totalprice < 12000 THEN NULL
                    ELSE ' $' || price END AS amount,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN '   '
                    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN NULL
                    ELSE ' ' || o_orderpriority END AS use_chip,
               (c_nationkey * 1000 + n_regionkey)::BIGINT AS merchant_id,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE ' ' || c_mktsegment || ' ' END AS merchant_city,
               CASE WHEN o_orderstatus = 'F' THEN NULL ELSE n_name END AS merchant_state,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN '  ' ELSE (10000 + o_custkey) || '.0' END AS zip,
               CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN NULL
                    ELSE 4000 + c_nationkey * 10 + n_regionkey END AS mcc,
               CASE o_orderstatus WHEN 'P' THEN 'Bad PIN' WHEN 'O' THEN ' ' END AS errors
        FROM raw_text""",
    "line_labels": """
        SELECT l_orderkey AS transaction_id, l_linenumber,
               CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 AND l_discount >= 0.08::DOUBLE THEN 'Yes' ELSE 'No' END AS label
        FROM lineitem""",
    "label_orders": """
        SELECT transaction_id, max(label) AS word, count(*) AS n_lines, max(l_linenumber) AS last_line
        FROM line_labels GROUP BY transaction_id""",
    "raw_labels": """
        SELECT transaction_id, label FROM (
          SELECT CASE WHEN n_lines >= 10 THEN NULL ELSE transaction_id END AS transaction_id,
                 CASE WHEN word = 'No' AND last_line = 1 THEN 'maybe'
                      WHEN word = 'Yes' AND n_lines % 2 = 0 THEN ' yes '
                      WHEN word = 'No' AND n_lines % 2 = 0 THEN 'NO'
                      ELSE word END AS label,
                 unnest(CASE WHEN n_lines >= 6 THEN [0, 1] ELSE [0] END) AS copy
          FROM label_orders)""",
    "parsed_tx": f"""
        SELECT id AS transaction_id,
               try_strptime(trim(date), '%Y-%m-%d %H:%M:%S') AS transaction_time,
               client_id, card_id,
               TRY_CAST(regexp_replace(trim(amount), '[$,]', '', 'g') AS DOUBLE) AS amount,
               coalesce({_blank_to_null('use_chip')}, 'Unknown') AS use_chip,
               merchant_id,
               {_blank_to_null('merchant_city')} AS merchant_city,
               {_blank_to_null('merchant_state')} AS merchant_state,
               regexp_replace({_blank_to_null('zip')}, '\\.0$', '') AS zip,
               mcc,
               {_blank_to_null('errors')} AS errors
        FROM raw_tx""",
    "valid_tx": """
        SELECT * FROM parsed_tx
        WHERE transaction_id IS NOT NULL AND transaction_time IS NOT NULL
          AND amount IS NOT NULL AND NOT isnan(amount) AND amount >= 0""",
    "clean_tx": f"""
        SELECT * EXCLUDE (copy_number), year(transaction_time)::INTEGER AS transaction_year FROM (
          SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {_copy_order}) AS copy_number
          FROM valid_tx) WHERE copy_number = 1""",
    "parsed_labels": """
        SELECT transaction_id, CASE upper(trim(label)) WHEN 'YES' THEN 1 WHEN 'NO' THEN 0 END AS class
        FROM raw_labels
        WHERE transaction_id IS NOT NULL AND upper(trim(label)) IN ('YES', 'NO')""",
    "clean_labels": "SELECT DISTINCT transaction_id, class FROM parsed_labels",
    "labeled": """
        SELECT transaction_id, transaction_time, client_id, card_id, amount, use_chip, merchant_id,
               merchant_city, merchant_state, zip, mcc, errors, class, transaction_year
        FROM clean_tx JOIN clean_labels USING (transaction_id)""",
    "features": """
        SELECT transaction_id, transaction_time, class, amount,
               hour(transaction_time)::DOUBLE AS transaction_hour,
               (dayofweek(transaction_time) + 1)::DOUBLE AS transaction_day_of_week,
               month(transaction_time)::DOUBLE AS transaction_month,
               year(transaction_time)::DOUBLE AS transaction_year_numeric,
               CASE WHEN dayofweek(transaction_time) IN (0, 6) THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend,
               CASE WHEN merchant_state IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS is_online,
               CASE WHEN errors IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS has_error,
               use_chip,
               coalesce(mcc::VARCHAR, 'Unknown') AS mcc_category,
               coalesce(merchant_state, 'ONLINE_OR_UNKNOWN') AS merchant_state_category
        FROM labeled""",
    "split_rows": f"""
        SELECT *, CASE WHEN {md5_bucket('transaction_id', 42)} >= 800000 THEN 'test'
                       WHEN {md5_bucket('transaction_id', 45)} >= 750000 THEN 'validation'
                       ELSE 'train' END AS split
        FROM labeled""",
    "train_rows": "SELECT * EXCLUDE (split) FROM split_rows WHERE split = 'train'",
    "validation_rows": "SELECT * EXCLUDE (split) FROM split_rows WHERE split = 'validation'",
    "test_rows": "SELECT * EXCLUDE (split) FROM split_rows WHERE split = 'test'",
    "scored": _scored("labeled"),
    "scored_validation": _scored("validation_rows"),
    "scored_test": _scored("test_rows"),
    "decided": "SELECT *, (fraud_probability >= 0.5::DOUBLE)::INTEGER AS prediction FROM scored",
    "predictions": """
        SELECT transaction_id, transaction_time, amount, fraud_probability, prediction,
               CASE WHEN prediction = 1 THEN 'NEEDS_REVIEW' ELSE 'NORMAL' END AS status,
               class AS actual_class, slug AS model
        FROM decided""",
    "confusion": f"SELECT slug, {counts('class', 'prediction')} FROM decided GROUP BY slug",
    "sweep_limits": f"SELECT threshold FROM (VALUES {doubles(THRESHOLDS)}) AS t(threshold)",
    "sweep": f"""
        SELECT slug, threshold, tp, tn, fp, fn, {rates()} FROM (
          SELECT slug, threshold, {counts('class', '(fraud_probability >= threshold)::INTEGER')}
          FROM scored CROSS JOIN sweep_limits GROUP BY slug, threshold)""",
    "validation_sweep": f"""
        SELECT slug, threshold, tp, tn, fp, fn, {rates()} FROM (
          SELECT slug, threshold, {counts('class', '(fraud_probability >= threshold)::INTEGER')}
          FROM scored_validation CROSS JOIN sweep_limits GROUP BY slug, threshold)""",
    "chosen": """
        SELECT * EXCLUDE (place) FROM (
          SELECT *, row_number() OVER (PARTITION BY slug ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC) AS place
          FROM validation_sweep) WHERE place = 1""",
    # Models are ranked by this, so it keeps all digits that engines can agree on.
    "validation_auc": pr_auc("scored_validation", "fraud_probability", 12),
    "feature_split": """
        SELECT features.*, split FROM features
        JOIN (SELECT transaction_id, split FROM split_rows) USING (transaction_id)""",
    "category_rows": " UNION ALL ".join(
        f"SELECT transaction_id, split, {part} AS part, '{c}' AS feature, {c} AS value FROM feature_split"
        for part, c in enumerate(CATEGORICAL_FEATURES)
    ),
    "category_slots": """
        SELECT *, (row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) - 1)::INTEGER AS slot
        FROM (SELECT part, feature, value, count(*) AS n FROM category_rows WHERE split = 'train' GROUP BY ALL)""",
    "category_starts": """
        SELECT *, (8 + coalesce(sum(width) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS start
        FROM (SELECT part, feature, (count(*) + 1)::INTEGER AS width FROM category_slots GROUP BY ALL)""",
    "numeric_entries": " UNION ALL ".join(
        f"SELECT transaction_id, split, {i} AS position, {c} AS value FROM feature_split"
        for i, c in enumerate(NUMERIC_FEATURES)
    ),
    "category_entries": """
        SELECT c.transaction_id, c.split, (start + coalesce(slot, width - 1))::INTEGER AS position, 1.0::DOUBLE AS value
        FROM category_rows c JOIN category_starts USING (feature)
        LEFT JOIN category_slots s ON c.feature = s.feature AND c.value = s.value""",
    "vector_entries": "SELECT * FROM numeric_entries UNION ALL SELECT * FROM category_entries",
    "vector_scales": """
        SELECT position, stddev_samp(value) AS deviation FROM numeric_entries WHERE split = 'train' GROUP BY position
        UNION ALL
        SELECT start + slot, sqrt(n * (total - n) / total / (total - 1))
        FROM category_slots JOIN category_starts USING (feature),
             (SELECT count(*)::DOUBLE AS total FROM train_rows)""",
    "score_buckets": """
        SELECT model AS slug, least(199, floor(fraud_probability * 200)::INTEGER) AS score_bucket,
               count(*) FILTER (actual_class = 1) AS positives,
               count(*) FILTER (actual_class = 0) AS negatives
        FROM predictions GROUP BY ALL""",
    "running": """
        SELECT *, sum(positives) OVER down::BIGINT AS tp, sum(negatives) OVER down::BIGINT AS fp,
               sum(positives) OVER (PARTITION BY slug)::BIGINT AS all_positives
        FROM score_buckets
        WINDOW down AS (PARTITION BY slug ORDER BY score_bucket DESC ROWS UNBOUNDED PRECEDING)""",
    "records": """
        SELECT event_id, CASE
            WHEN event_type = 'error' AND value < 10 THEN 'not json'
            WHEN event_type = 'error' THEN '{"note":"' || event_id || '"}'
            ELSE '{"transactionId":"' || event_id || '","accountId":"A' || user_id || '","amount":'
                 || CASE WHEN event_type = 'purchase' THEN '"' || value || '"' ELSE value::VARCHAR END
                 || ',"merchant_state":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '"S' || user_id || '"' END
                 || ',"errors":' || CASE WHEN event_type = 'click' THEN '"Bad PIN"' ELSE 'null' END
                 || ',"transaction_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}'
            END AS value
        FROM events""",
    "stream_events": """
        SELECT event_id::VARCHAR AS "transactionId", 'A' || user_id AS "accountId", value AS amount,
               event_type, date_trunc('second', ts) AS transaction_time
        FROM events WHERE event_type <> 'error'""",
    "rule_alerts": """
        SELECT "transactionId", "accountId", amount, 'USD' AS currency, 100.0::DOUBLE AS threshold,
               'NEEDS_REVIEW' AS status, 'HIGH_AMOUNT' AS reason
        FROM stream_events WHERE amount > 100""",
}


def with_views(query):
    """Puts the views a query names in front of it, each after the views it needs itself."""
    needed = []

    def need(text):
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(query)
    if not needed:
        return query
    views = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH {views}\n{query}"
