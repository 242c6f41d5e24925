"""Model inputs that need no fitting, and the fitted MLlib preprocessor."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from txrisk.functions import calendar, text
from txrisk.settings import CATEGORICAL_FEATURES, MAX_CATEGORIES, NUMERIC_FEATURES, UNKNOWN


def feature_columns():
    """The eleven inputs shared by training, batch scoring and the stream."""
    time = F.col("transaction_time")
    numeric = {
        "amount": F.col("amount").cast("double"),
        "transaction_hour": calendar.hour(time),
        "transaction_day_of_week": calendar.day_of_week(time),
        "transaction_month": calendar.month(time),
        "transaction_year_numeric": calendar.year(time),
        "is_weekend": calendar.is_weekend(time),
        "is_online": calendar.flag(text.is_missing("merchant_state")),
        "has_error": calendar.flag(~text.is_missing("errors")),
    }
    categories = {
        "use_chip": text.text_or("use_chip", UNKNOWN),
        "mcc_category": text.mcc_category(),
        "merchant_state_category": text.state_category(),
    }
    return numeric, categories


def _named(*groups):
    return [column.alias(name) for group in groups for name, column in group.items()]


def inference_features(transactions):
    return transactions.select("transaction_id", "transaction_time", *_named(*feature_columns()))


def training_features(labeled):
    """As for inference, with the class carried along; it is never a model input."""
    return labeled.select(
        "transaction_id", "transaction_time", "class", *_named(*feature_columns())
    )


def numeric_features(transactions, *carry):
    """Only the eight numbers, as the isolation forest takes them."""
    numeric, _ = feature_columns()
    return transactions.select(*carry, *_named(numeric))


def preprocessor():
    """Index, one-hot, assemble and scale; to be fitted on training rows only."""
    indexed = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    encoded = [f"{c}_ohe" for c in CATEGORICAL_FEATURES]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(CATEGORICAL_FEATURES),
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="frequencyDesc",
            ),
            OneHotEncoder(
                inputCols=indexed, outputCols=encoded, handleInvalid="keep", dropLast=True
            ),
            VectorAssembler(
                inputCols=[*NUMERIC_FEATURES, *encoded],
                outputCol="features_raw",
                handleInvalid="keep",
            ),
            StandardScaler(
                inputCol="features_raw", outputCol="features", withMean=False, withStd=True
            ),
        ]
    )


def require_bounded_categories(features, limit=MAX_CATEGORIES):
    """Indexing brings every category to the driver, so refuse columns that are really ids."""
    sizes = features.agg(*(F.count_distinct(c).alias(c) for c in CATEGORICAL_FEATURES)).first()
    wide = {c: sizes[c] for c in CATEGORICAL_FEATURES if sizes[c] > limit}
    if wide:
        raise ValueError(f"Too many categories to index (limit {limit}): {wide}")
    return features


def fit_preprocessor(train, max_categories=MAX_CATEGORIES):
    """Fitted on all rows given. A column may have up to ``max_categories`` different values."""
    return preprocessor().fit(require_bounded_categories(train, max_categories))


def feature_names(transformed):
    """Names by vector position, from the column metadata; ``feature_i`` where it has none."""
    field = transformed.schema["features_raw"]
    groups = field.metadata.get("ml_attr", {}).get("attrs", {})
    by_position = {a["idx"]: a["name"] for attrs in groups.values() for a in attrs}
    if by_position:
        return [by_position[i] for i in sorted(by_position)]
    head = transformed.select("features").first()
    return [f"feature_{i}" for i in range(head["features"].size)]
