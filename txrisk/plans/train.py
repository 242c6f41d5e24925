"""Labeled table to stored splits, preprocessor, five classifiers and the isolation forest."""

import time

from pyspark.sql import functions as F

from txrisk import settings
from txrisk.operators import classifiers, features, isolation_forest, sampling
from txrisk.session import written
from txrisk.sources import model_store, readers, writers

SPLITS = ("train", "validation", "test")


def write_splits(labeled, split_base):
    """All three splits from one scan, stored as ``split=<name>/class=<0|1>``."""
    named = sampling.with_split_name(features.training_features(labeled))
    return writers.write_table(named, split_base, "split", "class", rebalance=True)


def read_split(spark, split_base, name):
    if name not in SPLITS:
        raise ValueError(f"unknown split {name}; choose one of {', '.join(SPLITS)}")
    return readers.read_table(spark, split_base).where(F.col("split") == name).drop("split")


def _distributions(splits):
    """{split: {class: rows}}; at most six rows reach the driver."""
    found = {name: {0: 0, 1: 0} for name in SPLITS}
    for row in splits.groupBy("split", "class").count().collect():
        found[row["split"]][row["class"]] = row["count"]
    return found


def train(
    spark,
    labeled_path,
    split_base,
    model_base,
    report=None,
    max_training_rows=settings.MAX_TRAINING_ROWS,
    max_categories=settings.MAX_CATEGORIES,
    trees=settings.FOREST_SIZE,
    depth=settings.FOREST_DEPTH,
    undersample_ratio=settings.UNDERSAMPLE_RATIO,
):
    """Fits and stores everything and returns the report.

    The preprocessor sees training rows only; validation and test rows are never sampled.
    """
    write_splits(readers.read_table(spark, labeled_path), split_base)
    rows = _distributions(readers.read_table(spark, split_base))
    whole = sum(sum(counts.values()) for counts in rows.values())
    train_rows = sum(rows["train"].values())
    if not all(rows["train"].values()):
        raise ValueError(f"training needs both classes, found {rows['train']}")

    train_split = read_split(spark, split_base, "train")
    fitted = features.fit_preprocessor(train_split, max_categories)
    check_rows = read_split(spark, split_base, "test").orderBy("transaction_id").limit(10)
    fitted = model_store.save_checked(
        fitted, f"{model_base}/{model_store.PREPROCESSOR}", type(fitted).load, check_rows
    )

    # Iterative fits read the vectors many times, so both training tables are stored.
    capped = sampling.cap_rows(train_split, max_training_rows)
    vectors = written(fitted.transform(capped), "capped-vectors")
    weights = {row["class"]: row for row in sampling.class_weights(vectors).collect()}
    if set(weights) != {0, 1}:
        raise ValueError("the capped training rows hold only one class")
    weighted = sampling.with_class_weight(vectors, weights[0]["weight"], weights[1]["weight"])
    thinned = written(
        fitted.transform(sampling.undersample(train_split, undersample_ratio)), "thinned-vectors"
    )
    inputs = {"None": vectors, "Class Weight": weighted, "Undersampling": thinned}

    names = features.feature_names(vectors)
    check_vectors = fitted.transform(check_rows)
    seconds, paths = {}, {"preprocessor": f"{model_base}/{model_store.PREPROCESSOR}"}
    for slug, spec in classifiers.MODELS.items():
        model, seconds[slug] = classifiers.timed_fit(
            classifiers.estimator_for(slug, trees, depth), inputs[spec.balancing]
        )
        model_store.save_classifier(slug, model, model_base, check_vectors)
        paths[slug] = f"{model_base}/{spec.folder}"
    thinned_rows = {r["class"]: r["rows"] for r in sampling.class_weights(thinned).collect()}

    started = time.perf_counter()
    scorer = model_store.save_forest(
        isolation_forest.fit_forest(train_split), model_base
    )
    if isolation_forest.score_forest(scorer, check_rows).count() != check_rows.count():
        raise RuntimeError("the reloaded forest did not score all check rows")
    seconds[settings.FOREST_SLUG] = round(time.perf_counter() - started, 3)
    paths[settings.FOREST_SLUG] = f"{model_base}/{settings.FOREST_SLUG}"

    def by_class(counts):
        return [{"class": c, "rows": n} for c, n in sorted(counts.items())]

    result = {
        "splits": [
            {"name": name, "path": split_base, "share": sum(counts.values()) / whole, "classes": by_class(counts)}
            for name, counts in rows.items()
        ],
        "fits": [
            {"slug": slug, "path": paths[slug], "seconds": taken} for slug, taken in seconds.items()
        ],
        "preprocessor": {"path": paths["preprocessor"], "fitted_on_rows": train_rows, "vector": names},
        "balancing": {
            "cap": max_training_rows,
            "capped": [{"class": c, "rows": w["rows"], "weight": w["weight"]} for c, w in sorted(weights.items())],
            "ratio": undersample_ratio,
            "thinned": by_class(thinned_rows),
        },
        "forests": {
            "random": {"trees": trees, "depth": depth},
            "isolation": {"trees": settings.FOREST_TREES, "sample": settings.FOREST_SAMPLE},
        },
    }
    writers.write_report(spark, result, f"{model_base}/{settings.TRAINING_REPORT}")
    if report:
        writers.write_report(spark, result, report)
    return result
