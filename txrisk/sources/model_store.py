"""Saving, loading and re-checking models below one base folder."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from txrisk.operators.classifiers import MODELS, model_spec
from txrisk.operators.isolation_forest import ForestScorer, score_forest
from txrisk.session import written
from txrisk.settings import FOREST_SLUG
from txrisk.sources.publish import publish

PREPROCESSOR = "preprocessor"


def _predictions(model, rows):
    """What the model adds to the check rows, in a fixed order."""
    found = model.transform(rows)
    added = [c for c in found.columns if c not in rows.columns]
    return sorted(repr(row) for row in found.select("transaction_id", *added).collect())


def save_checked(model, path, load, rows, most_rows=1000):
    """Saves the model, provided that it predicts the same for ``rows`` once it is loaded again.

    It is written under an unfinished name and takes the place of what was there only after the
    check, so a save that fails leaves the model before it. Check rows are few and reach the driver.
    """
    few = written(rows.limit(most_rows), "check-rows")
    expected = _predictions(model, few)

    def check(name):
        loaded = load(name)
        if not expected or _predictions(loaded, few) != expected:
            raise RuntimeError(f"the model reloaded for {path} does not predict what was fitted")
        return loaded

    return publish(few.sparkSession, path, lambda name: model.write().save(name), check)


def save_classifier(slug, model, base, rows):
    spec = model_spec(slug)
    return save_checked(model, f"{base}/{spec.folder}", spec.model_class.load, rows)


def load_classifier(slug, base):
    spec = model_spec(slug)
    return spec.model_class.load(f"{base}/{spec.folder}")


def load_preprocessor(base):
    return PipelineModel.load(f"{base}/{PREPROCESSOR}")


def save_forest(nodes, base):
    """Stores the node table and returns a scorer over what was stored."""
    def check(name):
        if not nodes.sparkSession.read.parquet(name).head(1):
            raise RuntimeError("a forest without nodes is not stored")

    publish(nodes.sparkSession, f"{base}/{FOREST_SLUG}", lambda name: nodes.write.parquet(name), check)
    return load_forest(nodes.sparkSession, base)


def load_forest(spark, base):
    return ForestScorer(spark.read.parquet(f"{base}/{FOREST_SLUG}"))


def check_all_models(spark, base, features, rows=100):
    """(slug, scored): every stored model loaded afresh and run over a few rows."""
    few = written(features.orderBy("transaction_id").limit(rows), "check-rows")
    sample = load_preprocessor(base).transform(few)
    counts = [
        load_classifier(slug, base).transform(sample).agg(
            F.lit(slug).alias("slug"), F.count("prediction").alias("scored")
        )
        for slug in MODELS
    ]
    forest = score_forest(load_forest(spark, base), sample)
    result = forest.agg(F.lit(FOREST_SLUG).alias("slug"), F.count("anomaly_score").alias("scored"))
    for one in counts:
        result = result.unionByName(one)
    return result
