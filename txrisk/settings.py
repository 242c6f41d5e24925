"""Names and numbers the rest of the package agrees on."""

# --- Fixed values -----------------------------------------------------------
# These must stay as they are: stored tables, splits and models depend on them.

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

UNKNOWN = "Unknown"
NO_STATE = "ONLINE_OR_UNKNOWN"
NEEDS_REVIEW = "NEEDS_REVIEW"
NORMAL = "NORMAL"

HASH_BUCKETS = 1_000_000
SPLIT_SEED = 42
CAP_SEED = 43
UNDERSAMPLE_SEED = 44
VALIDATION_SEED = 45
# The forest sample needs a seed no split uses, or it would only see low split buckets.
FOREST_SEED = 46

TRAIN_POOL_FRACTION = 0.8
TRAIN_FRACTION_OF_POOL = 0.75
MAX_TRAINING_ROWS = 500_000
MAX_CATEGORIES = 50_000  # per column; they are indexed by the driver
UNDERSAMPLE_RATIO = 10.0

THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
DEFAULT_THRESHOLD = 0.5
DEFAULT_MODEL = "rf_undersampling"

NUMERIC_FEATURES = (
    "amount",
    "transaction_hour",
    "transaction_day_of_week",
    "transaction_month",
    "transaction_year_numeric",
    "is_weekend",
    "is_online",
    "has_error",
)
CATEGORICAL_FEATURES = ("use_chip", "mcc_category", "merchant_state_category")

FOREST_SLUG = "isolation_forest"
FOREST_TREES = 200
FOREST_SAMPLE = 256
MAX_FOREST_NODES = 2_000_000

# Where reports are kept below the model folder.
TRAINING_REPORT = "metadata/training.json"
EVALUATION_REPORT = "metadata/evaluation.json"

# Training parameters.
LOGISTIC_REGRESSION = {
    "maxIter": 20,
    "regParam": 0.01,
    "elasticNetParam": 0.0,
    "standardization": False,
}
RANDOM_FOREST = {"featureSubsetStrategy": "sqrt", "subsamplingRate": 0.8}
FOREST_SIZE = 25
FOREST_DEPTH = 8

HIGH_AMOUNT_THRESHOLD = 1000.0
MIN_ANOMALY_SCORE = 0.05
ALERT_FEED_ROWS = 100
SUSPICIOUS_ROWS = 20
STREAM_TRIGGER = "10 seconds"
