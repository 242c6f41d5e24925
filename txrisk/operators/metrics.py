"""Confusion counts, rates, threshold sweeps and precision-recall, for many models at once.

Every operator takes long tables of scored rows with the model in a ``slug`` column and groups
by it, so one job covers all models.
"""

from pyspark.sql import Window, functions as F

from txrisk.functions.scoring import ratio
from txrisk.settings import THRESHOLDS

COUNTS = ("tp", "tn", "fp", "fn")


def _score_block(score, digits):
    """A number that sorts like the score: its power of two, then ``digits`` binary places."""
    size = F.abs(score.cast("double"))
    power = F.when(size > 0, F.greatest(F.lit(-60), F.floor(F.log2(size)))).otherwise(F.lit(-61))
    inside = F.floor(F.try_divide(size, F.pow(F.lit(2.0), power)) * F.lit(float(1 << digits)))
    ranked = (power + 62) * F.lit(1 << (digits + 2)) + F.least(inside, F.lit((1 << (digits + 2)) - 1))
    return F.when(score < 0, -ranked).otherwise(ranked).cast("bigint")


def confusion_counts(df, by=("slug",), label="class", prediction="prediction"):
    """tp, tn, fp, fn in one aggregation."""
    actual, predicted = F.col(label).cast("int"), F.col(prediction).cast("int")
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return df.groupBy(*by).agg(
        *(F.count_if((actual == a) & (predicted == p)).alias(k) for k, (a, p) in cells.items())
    )


def with_rates(counts):
    """Adds evaluation_rows, precision, recall, f1, specificity and accuracy; 0 for x/0."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    rows = tp + tn + fp + fn
    rated = counts.select(
        "*",
        rows.alias("evaluation_rows"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp + tn, rows).alias("accuracy"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", ratio(2 * p * r, p + r))


def binary_metrics(df, by=("slug",), label="class", prediction="prediction"):
    return with_rates(confusion_counts(df, by, label, prediction))


def threshold_sweep(df, score, thresholds=THRESHOLDS, by=("slug",), label="class"):
    """(slug, threshold, counts, rates) for every threshold, in a single aggregation.

    Two counters per threshold and the class totals are enough; the other two cells follow.
    """
    if not thresholds:
        raise ValueError("at least one threshold is needed")
    if any(not 0.0 <= t <= 1.0 for t in thresholds):
        raise ValueError(f"thresholds must lie in [0, 1]: {thresholds}")
    actual = F.col(label).cast("int")
    scored = df.where(F.col(score).isNotNull())
    counters = [
        F.count_if((actual == c) & (F.col(score) >= float(t))).alias(f"n{i}_{c}")
        for i, t in enumerate(thresholds)
        for c in (0, 1)
    ]
    wide = scored.groupBy(*by).agg(
        F.count_if(actual == 1).alias("positives"),
        F.count_if(actual == 0).alias("negatives"),
        *counters,
    )
    lines = F.array(
        *(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"n{i}_1").alias("tp"),
                (F.col("negatives") - F.col(f"n{i}_0")).alias("tn"),
                F.col(f"n{i}_0").alias("fp"),
                (F.col("positives") - F.col(f"n{i}_1")).alias("fn"),
            )
            for i, t in enumerate(thresholds)
        )
    )
    return with_rates(wide.select(*by, F.inline(lines)))


def area_under_pr(df, score, by=("slug",), label="class", digits=14):
    """Exact area under the precision-recall curve, one point per distinct score.

    Rows are folded to counts per distinct score. Running counts are then taken in two levels: a
    block is what agrees in the leading bits of the score's own binary form, which sort like the
    score; totals per block give each block its starting point, and the running sum inside a block
    is its own window partition. A block of scores between 0 and 1 spans 2^-``digits`` of its
    power of two, so there is a fixed number of blocks whatever the number of rows, and no task
    sees more than the distinct scores of one block.
    """
    actual = F.col(label).cast("int")
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(score) & actual.isin(0, 1))
    per_score = usable.groupBy(*by, score).agg(
        F.count_if(actual == 1).alias("pos"), F.count_if(actual == 0).alias("neg")
    )
    per_score = per_score.withColumn("block", _score_block(F.col(score), digits))
    higher = Window.partitionBy(*by).orderBy(F.desc("block")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    model = Window.partitionBy(*by)
    starts = (
        per_score.groupBy(*by, "block")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(
            *by,
            "block",
            F.coalesce(F.sum("pos").over(higher), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("neg").over(higher), F.lit(0)).alias("neg_above"),
            F.sum("pos").over(model).alias("positives"),
        )
    )
    inside = Window.partitionBy(*by, "block").orderBy(F.desc(score)).rowsBetween(
        Window.unboundedPreceding, 0
    )
    points = per_score.join(starts, [*by, "block"]).select(
        *by,
        "pos",
        "neg",
        "positives",
        (F.col("pos_above") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("neg_above") + F.sum("neg").over(inside)).alias("fp"),
    )
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    precision = tp / (tp + fp)
    # The curve starts at recall 0 with the precision of its first point.
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), precision)
    strip = F.try_divide(pos, F.col("positives")) * (precision + before) / 2.0
    return points.groupBy(*by).agg(F.coalesce(F.sum(strip), F.lit(0.0)).alias("pr_auc"))


def score_buckets(df, score, bins=200, by=("slug",), label="actual_class"):
    """(slug, score_bucket, positives, negatives): at most ``bins`` rows per model."""
    bucket = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins).cast("int"))
    actual = F.col(label).cast("int")
    return (
        df.where(F.col(score).isNotNull() & actual.isin(0, 1))
        .groupBy(*by, bucket.alias("score_bucket"))
        .agg(
            F.count_if(actual == 1).alias("positives"),
            F.count_if(actual == 0).alias("negatives"),
        )
    )


def running_counts(buckets, by=("slug",)):
    """Adds tp and fp at each bucket: everything scored there or higher."""
    down = Window.partitionBy(*by).orderBy(F.desc("score_bucket")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return buckets.select(
        "*",
        F.sum("positives").over(down).alias("tp"),
        F.sum("negatives").over(down).alias("fp"),
        F.sum("positives").over(Window.partitionBy(*by)).alias("all_positives"),
    )


def pr_curve(df, score, bins=200, by=("slug",), label="actual_class"):
    """(slug, threshold, precision, recall) over score bins, from (1, 1, 0) downwards."""
    running = running_counts(score_buckets(df, score, bins, by, label), by)
    tp, fp = F.col("tp"), F.col("fp")
    point = F.struct(
        (F.col("score_bucket") / F.lit(float(bins))).alias("threshold"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)).alias("precision"),
        ratio(tp, F.col("all_positives")).alias("recall"),
    )
    start = F.struct(
        F.lit(1.0).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    is_first = tp + fp == F.col("positives") + F.col("negatives")
    return running.select(*by, F.inline(F.when(is_first, F.array(start, point)).otherwise(F.array(point))))


def select_thresholds(sweep, by=("slug",)):
    """Per model the sweep row with the best f1, then precision, recall, threshold."""
    keys = ("f1", "precision", "recall", "threshold")
    best = sweep.groupBy(*by).agg(
        F.max_by(F.struct(*sweep.columns), F.struct(*keys)).alias("best")
    )
    return best.select("best.*")


def recommend_model(selection):
    """The one model with the best validation PR-AUC, then f1, precision, and slug."""
    order = [F.desc("pr_auc"), F.desc("f1"), F.desc("precision"), F.asc("slug")]
    return selection.orderBy(*order).limit(1)


def confusion_matrix(counts, slug):
    """Long 2x2 matrix of one model: (actual, predicted, count)."""
    cells = F.array(
        *(
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("count"))
            for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        )
    )
    return counts.where(F.col("slug") == slug).select(F.inline(cells))
