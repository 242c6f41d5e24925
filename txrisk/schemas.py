"""Column layouts of the tables this package reads and writes (fixed values)."""

RAW_TRANSACTIONS = """
    id BIGINT, date STRING, client_id BIGINT, card_id BIGINT, amount STRING,
    use_chip STRING, merchant_id BIGINT, merchant_city STRING, merchant_state STRING,
    zip STRING, mcc INT, errors STRING
"""

RAW_LABELS = "transaction_id BIGINT, label STRING"

NEW_TRANSACTIONS = """
    transaction_id BIGINT, transaction_time STRING, amount DOUBLE, use_chip STRING,
    merchant_state STRING, mcc INT, errors STRING
"""

LABELED_COLUMNS = (
    "transaction_id", "transaction_time", "client_id", "card_id", "amount", "use_chip",
    "merchant_id", "merchant_city", "merchant_state", "zip", "mcc", "errors", "class",
    "transaction_year",
)

NEW_PREDICTION_COLUMNS = (
    "transaction_id", "transaction_time", "amount", "fraud_probability", "prediction",
    "status", "model", "threshold",
)

# Result tables, by file name.
RESULT_TABLES = {
    "class_distribution": ("class", "count"),
    "amount_histogram": ("bin", "lower", "upper", "center", "count"),
    "fraud_amount_histogram": ("bin", "lower", "upper", "center", "count"),
    "probability_histogram": ("bin", "lower", "upper", "center", "count"),
    "model_comparison": (
        "slug", "model", "imbalance_method", "evaluation_rows", "precision", "recall", "f1",
        "pr_auc", "accuracy",
    ),
    "imbalance_experiments": (
        "slug", "model", "imbalance_method", "evaluation_rows", "precision", "recall", "f1",
        "pr_auc", "accuracy",
    ),
    "confusion_matrices": ("slug", "model", "tp", "tn", "fp", "fn"),
    "threshold_analysis": (
        "slug", "model", "threshold", "precision", "recall", "f1", "tp", "tn", "fp", "fn",
    ),
    "rf_feature_importance": ("slug", "feature", "importance"),
    "top_features": ("slug", "rank", "feature", "importance"),
    "confusion_matrix": ("actual", "predicted", "count"),
    "precision_recall_curve": ("slug", "threshold", "precision", "recall"),
    "top_suspicious_transactions": (
        "transaction_id", "transaction_time", "amount", "fraud_probability", "status",
        "actual_class", "model",
    ),
}

STREAM_EVENT = """
    transactionId STRING, accountId STRING, amount STRING, currency STRING,
    transaction_time STRING, merchant_state STRING, errors STRING, _corrupt_record STRING
"""
