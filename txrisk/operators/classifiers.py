"""The five classifiers, their registry, and how they are fitted and scored together."""

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.sql import functions as F

from txrisk import settings
from txrisk.functions.scoring import fraud_probability


@dataclass(frozen=True)
class ModelSpec:
    slug: str
    family: str
    balancing: str
    folder: str
    model_class: type

    @property
    def is_forest(self):
        return self.model_class is RandomForestClassificationModel


# Slugs, display names and folders of stored models.
MODELS = {
    spec.slug: spec
    for spec in (
        ModelSpec("lr_none", "Logistic Regression", "None",
                  "logistic_regression/none", LogisticRegressionModel),
        ModelSpec("lr_class_weight", "Logistic Regression", "Class Weight",
                  "logistic_regression/class_weight", LogisticRegressionModel),
        ModelSpec("rf_none", "Random Forest", "None",
                  "random_forest/none", RandomForestClassificationModel),
        ModelSpec("rf_class_weight", "Random Forest", "Class Weight",
                  "random_forest/class_weight", RandomForestClassificationModel),
        ModelSpec("rf_undersampling", "Random Forest", "Undersampling",
                  "random_forest/undersampling", RandomForestClassificationModel),
    )
}


def model_spec(slug):
    if slug not in MODELS:
        raise ValueError(f"unknown model {slug}; choose one of {', '.join(sorted(MODELS))}")
    return MODELS[slug]


def _weighted(estimator, weight_column):
    return estimator.setWeightCol(weight_column) if weight_column else estimator


def logistic_regression(weight_column=None):
    """A few steps with a light ridge penalty; the vectors are scaled already."""
    estimator = LogisticRegression(labelCol="class", **settings.LOGISTIC_REGRESSION)
    return _weighted(estimator, weight_column)


def random_forest(weight_column=None, trees=settings.FOREST_SIZE, depth=settings.FOREST_DEPTH):
    estimator = RandomForestClassifier(
        labelCol="class", numTrees=trees, maxDepth=depth, seed=settings.SPLIT_SEED,
        **settings.RANDOM_FOREST,
    )
    return _weighted(estimator, weight_column)


def estimator_for(slug, trees=settings.FOREST_SIZE, depth=settings.FOREST_DEPTH):
    spec = model_spec(slug)
    weight = "class_weight" if spec.balancing == "Class Weight" else None
    return random_forest(weight, trees, depth) if spec.is_forest else logistic_regression(weight)


def timed_fit(estimator, rows):
    """(model, seconds)"""
    started = time.perf_counter()
    model = estimator.fit(rows)
    return model, round(time.perf_counter() - started, 3)


def score_all(models, features, *carry):
    """Long table (slug, ids, carried columns, fraud_probability) of every model.

    All models run over the rows in one pass; the feature vectors are read once, not once per
    model, and only the narrow result is fanned out.
    """
    def apply(df, item):
        slug, model = item
        own = model.copy().setProbabilityCol(f"p_{slug}").setRawPredictionCol("")
        return own.setPredictionCol("").transform(df)

    wide = reduce(apply, models.items(), features)
    scores = F.array(
        *(
            F.struct(F.lit(slug).alias("slug"), fraud_probability(f"p_{slug}").alias("p"))
            for slug in models
        )
    )
    return wide.select(
        "transaction_id", "transaction_time", "amount", *carry, F.inline(scores).alias("slug", "fraud_probability")
    )


def feature_importance(spark, slug, model, names):
    """(slug, feature, importance): one row per vector position."""
    rows = [(slug, name, float(v)) for name, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "slug STRING, feature STRING, importance DOUBLE")
