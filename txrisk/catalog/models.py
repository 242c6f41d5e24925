"""Fitted preprocessors and models over the given tables.

SQL can follow the preprocessor exactly. It cannot repeat a model fit: where a fit is involved it
checks which rows come out and that they are sound, or nothing, and tests check the rest.
"""

from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txrisk.catalog.registry import query, rounded
from txrisk.operators import categories, certificates, classifiers, features, isolation_forest, sampling
from txrisk.operators.cleaning import unlabeled_transactions
from txrisk.plans.predict import score_new
from txrisk.session import scratch_path, written
from txrisk.settings import CATEGORICAL_FEATURES, LOGISTIC_REGRESSION, NUMERIC_FEATURES
from txrisk.sources import model_store


class Fitted:
    """Splits, preprocessor and vectors of one query, computed from the whole labeled table."""

    def __init__(self, v):
        self.splits = {name: features.training_features(df) for name, df in v.splits.items()}
        self.preprocessor = features.fit_preprocessor(self.splits["train"])
        self.train = self.preprocessor.transform(self.splits["train"])
        self.test = self.preprocessor.transform(self.splits["test"])

    @cached_property
    def vectors(self):
        """The training vectors, written once for all classifiers and in parts that keep all cores busy."""
        narrow = self.train.select("transaction_id", "class", "features")
        return written(narrow.repartition(self.parts(), "transaction_id"), "training-vectors")

    def parts(self):
        spark = self.train.sparkSession
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    @cached_property
    def undersampled(self):
        return written(sampling.undersample(self.vectors), "undersampled-vectors")

    def training_rows(self, slug):
        balancing = classifiers.model_spec(slug).balancing
        if balancing == "None":
            return self.vectors
        if balancing == "Class Weight":
            rows = {r["class"]: r for r in sampling.class_weights(self.vectors).collect()}
            return sampling.with_class_weight(self.vectors, rows[0]["weight"], rows[1]["weight"])
        return self.undersampled

    def fit(self, slug):
        return classifiers.timed_fit(classifiers.estimator_for(slug), self.training_rows(slug))[0]


def _recomputed(slug, model, rows):
    """``rows`` with the fraud probability worked out from the coefficients, or tree by tree."""
    if not classifiers.MODELS[slug].is_forest:
        weights = F.lit(model.coefficients.toArray().tolist())
        terms = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        margin = F.aggregate(terms, F.lit(model.intercept), lambda total, term: total + term)
        return rows.withColumn("again", 1.0 / (1.0 + F.exp(-margin)))
    for i, tree in enumerate(model.trees):
        own = tree.copy().setProbabilityCol(f"t{i}").setRawPredictionCol("").setPredictionCol("")
        rows = own.transform(rows)
    shares = [vector_to_array(f"t{i}")[1] for i in range(len(model.trees))]
    return rows.withColumn("again", sum(shares[1:], shares[0]) / len(shares))


def _scores(slug):
    def run(v):
        fitted = Fitted(v)
        model = fitted.fit(slug)
        p = F.col("fraud_probability")
        again = _recomputed(slug, model, fitted.test)
        scored = classifiers.score_all({slug: model}, again, "class", "again")
        return scored.select(
            "slug", "transaction_id", "class", (p.between(0, 1) & (F.abs(p - F.col("again")) < 1e-9)).alias("sound")
        )

    return run


def _expected_scores(slug):
    return f"SELECT '{slug}' AS slug, transaction_id, class, true AS sound FROM test_rows"


for _name, _slug in (
    ("ml_11_logistic_regression", "lr_none"),
    ("ml_12_logistic_regression_weighted", "lr_class_weight"),
    ("ml_13_random_forest", "rf_none"),
    ("ml_14_random_forest_weighted", "rf_class_weight"),
    ("ml_15_random_forest_undersampled", "rf_undersampling"),
):
    query(_name, _expected_scores(_slug))(_scores(_slug))


@query(
    "ml_15_fit_certificates",
    """SELECT slug, (SELECT count(*) FROM train_rows WHERE class = 1) AS fraud_rows, true AS certified
       FROM (VALUES ('lr_none'), ('lr_class_weight'), ('rf_none'), ('rf_class_weight'), ('rf_undersampling')) AS m(slug)""",
)
def _(v):
    """Each classifier against its own training rows: the gradient of its loss, or the shares in its leaves."""
    fitted, found = Fitted(v), []
    for slug, spec in classifiers.MODELS.items():
        rows = fitted.training_rows(slug)
        weight = "class_weight" if spec.balancing == "Class Weight" else None
        model = classifiers.timed_fit(classifiers.estimator_for(slug), rows)[0]
        certified = certificates.is_certified(rows, model, LOGISTIC_REGRESSION["regParam"], weight)
        found.append((slug, rows.where(F.col("class") == 1).count(), certified))
    return v.spark.createDataFrame(found, "slug STRING, fraud_rows BIGINT, certified BOOLEAN")


def _entries(vectors, column):
    """(transaction_id, position, value) of everything but zeros."""
    values = vectors.select("transaction_id", F.posexplode(vector_to_array(column)).alias("position", "value"))
    return values.where(F.col("value") != 0)


@query(
    "ml_02_one_hot",
    "SELECT transaction_id, "
    + ", ".join(
        f"max(coalesce(slot, width - 1)) FILTER (part = {i})::INTEGER AS {c}_slot, "
        f"max(width) FILTER (part = {i})::INTEGER AS {c}_width"
        for i, c in enumerate(CATEGORICAL_FEATURES)
    )
    + """ FROM (SELECT c.transaction_id, c.part, slot, width FROM category_rows c
              JOIN category_starts USING (feature)
              LEFT JOIN category_slots s ON c.feature = s.feature AND c.value = s.value
              WHERE c.split = 'test') GROUP BY transaction_id""",
)
def _(v):
    test = Fitted(v).test
    columns = []
    for c in CATEGORICAL_FEATURES:
        slots = vector_to_array(f"{c}_ohe")
        columns += [
            (F.array_position(slots, 1.0) - 1).cast("int").alias(f"{c}_slot"),
            F.size(slots).alias(f"{c}_width"),
        ]
    return test.select("transaction_id", *columns)


@query(
    "ml_03_assembled_vector",
    "SELECT transaction_id, position, value FROM vector_entries WHERE split = 'train' AND value <> 0",
)
def _(v):
    return _entries(Fitted(v).train, "features_raw")


@query(
    "ml_05_preprocessed_vector",
    """SELECT transaction_id, position, round(value / deviation, 6) AS value
       FROM vector_entries JOIN vector_scales USING (position)
       WHERE split = 'test' AND value <> 0 AND deviation > 0""",
)
def _(v):
    return rounded(_entries(Fitted(v).test, "features"), "value")


@query(
    "ml_05_distributed_vector",
    """SELECT transaction_id, position, round(value / deviation, 6) AS value
       FROM vector_entries JOIN vector_scales USING (position)
       WHERE split = 'test' AND value <> 0 AND deviation > 0""",
)
def _(v):
    """The same vectors from a dictionary that stays a table."""
    splits = {name: features.training_features(df) for name, df in v.splits.items()}
    dictionary = categories.category_dictionary(splits["train"])
    scales = categories.entry_scales(splits["train"], dictionary)
    entries = categories.sparse_entries(splits["test"], dictionary)
    return rounded(categories.scaled_entries(entries, scales), "value")


@query(
    "ml_06_feature_names",
    "SELECT position, name FROM (VALUES "
    + ", ".join(f"({i}, '{c}')" for i, c in enumerate(NUMERIC_FEATURES))
    + """) AS numbers(position, name)
    UNION ALL SELECT start + slot, feature || '_ohe_' || value FROM category_slots JOIN category_starts USING (feature)
    UNION ALL SELECT start + width - 1, feature || '_ohe___unknown' FROM category_starts""",
)
def _(v):
    names = features.feature_names(Fitted(v).test)
    return v.spark.createDataFrame(list(enumerate(names)), "position INT, name STRING")


@query(
    "agg_28_feature_importance",
    """SELECT 'rf_undersampling' AS slug, 8 + sum(width)::BIGINT AS features, true AS sound FROM category_starts""",
)
def _(v):
    fitted = Fitted(v)
    found = classifiers.feature_importance(
        v.spark, "rf_undersampling", fitted.fit("rf_undersampling"), features.feature_names(fitted.train)
    )
    whole = (F.min("importance") >= 0) & (F.abs(F.sum("importance") - 1.0) < 1e-9)
    return found.groupBy("slug").agg(F.count_distinct("feature").alias("features"), whole.alias("sound"))


@query(
    "ml_17_isolation_forest_fit",
    """SELECT tree::INTEGER AS tree, least(256, (SELECT count(*) FROM train_rows))::INTEGER AS sample_size, true AS sound
       FROM range(200) AS t(tree)""",
)
def _(v):
    """Each tree has a full sample; every inner node has two children, every node but one a parent."""
    nodes = written(isolation_forest.fit_forest(features.training_features(v.splits["train"])), "forest")
    inner = F.col("feature") >= 0
    children = F.flatten(F.collect_list(F.when(inner, F.array("left", "right"))))
    shapes = nodes.groupBy("tree").agg(
        F.max("sample_size").alias("sample_size"), F.count(F.lit(1)).alias("nodes"), children.alias("children"),
        F.count_if(~inner & (F.col("path") >= 0)).alias("leaves"),
    )
    each_once = F.sort_array("children") == F.sequence(F.lit(1), F.col("nodes").cast("int") - 1)
    return shapes.select("tree", "sample_size", (each_once & (F.col("leaves") * 2 == F.col("nodes") + 1)).alias("sound"))


@query(
    "ml_18_isolation_forest_score",
    "SELECT transaction_id, class, true AS sound FROM test_rows",
)
def _(v):
    splits = {name: features.training_features(df) for name, df in v.splits.items()}
    nodes = written(isolation_forest.fit_forest(splits["train"]), "forest")
    scored = isolation_forest.score_forest(isolation_forest.ForestScorer(nodes), splits["test"], "class")
    score = F.col("anomaly_score")
    decided = (score > 0) == (F.col("prediction") == 1)
    return scored.select("transaction_id", "class", (score.between(-0.5, 0.5) & decided).alias("sound"))


@query(
    "ml_21_batch_inference",
    """SELECT transaction_id, transaction_time, amount, 'rf_undersampling' AS model, 0.5::DOUBLE AS threshold,
              true AS sound
       FROM clean_tx WHERE transaction_id NOT IN (SELECT transaction_id FROM clean_labels)""",
)
def _(v):
    fitted = Fitted(v)
    base = scratch_path(v.spark, "models")
    slug = "rf_undersampling"
    check = fitted.test.limit(10)
    model_store.save_classifier(slug, fitted.fit(slug), base, check)
    fitted.preprocessor.write().save(f"{base}/{model_store.PREPROCESSOR}")
    new = unlabeled_transactions(v.clean, v.labels)
    scored = score_new(
        new, model_store.load_preprocessor(base), model_store.load_classifier(slug, base), slug, 0.5
    )
    p = F.col("fraud_probability")
    decision = (p >= 0.5) == (F.col("prediction") == 1)
    status = (F.col("status") == "NEEDS_REVIEW") == (F.col("prediction") == 1)
    return scored.select(
        "transaction_id", "transaction_time", "amount", "model", "threshold",
        (p.between(0, 1) & decision & status).alias("sound"),
    )


@query(
    "ml_22_reload_all_models",
    """SELECT slug, least(100, (SELECT count(*) FROM test_rows)) AS scored
       FROM (VALUES ('lr_none'), ('lr_class_weight'), ('rf_none'), ('rf_class_weight'),
                    ('rf_undersampling'), ('isolation_forest')) AS m(slug)""",
)
def _(v):
    fitted = Fitted(v)
    base = scratch_path(v.spark, "models")
    check = fitted.test.limit(10)
    fitted.preprocessor.write().save(f"{base}/{model_store.PREPROCESSOR}")
    for slug in classifiers.MODELS:
        model_store.save_classifier(slug, fitted.fit(slug), base, check)
    model_store.save_forest(isolation_forest.fit_forest(fitted.splits["train"]), base)
    return model_store.check_all_models(v.spark, base, fitted.splits["test"])
