"""Is a fitted classifier the one that its training rows ask for?

For logistic regression the penalised loss has one minimum, and its gradient tells how far away it
is. Loss and gradient come from one aggregation over the training vectors and have nothing in
common with the solver. For a forest, training rows are routed to the leaves of every tree: the
share of fraud in a leaf may differ from the tree's own only by the draw of the tree's rows.
"""

import math
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from txrisk.session import written

#: A gradient this much shorter than that of the best constant, after the few steps of a fit.
MOST_GRADIENT = 0.5
#: Mean deviation of a forest's trees: 0.7 to 2.7 in right fits, as splits are chosen on the draw they
#: are judged by; 5 and far more on other labels, where leaves hold enough rows to tell.
MOST_DEVIATION = 4.0
LEAST_SHARE = 1e-3  # probabilities are kept this far from 0 and 1 where a loss is taken


def margin(model, column="features"):
    """The linear margin worked out from the coefficients, entry by entry."""
    weights = F.lit(model.coefficients.toArray().tolist())
    terms = F.zip_with(vector_to_array(column), weights, lambda x, w: x * w)
    return F.aggregate(terms, F.lit(float(model.intercept)), lambda total, term: total + term)


def _loss_and_gradient(rows, score, weight, label):
    """(total weight, mean loss, gradient by coefficient, gradient of the intercept), unpenalised.

    Summaries take weights of zero and more only, so residuals are summed by sign. Two rows as wide
    as the model reach the driver.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    measured = rows.select("features", F.col(label).cast("double").alias("y"), w.alias("w"), score.alias("m"))
    p = 1.0 / (1.0 + F.exp(-F.col("m")))
    loss = F.greatest(F.col("m"), F.lit(0.0)) - F.col("m") * F.col("y") + F.log1p(F.exp(-F.abs("m")))
    residual = F.col("w") * (p - F.col("y"))
    sides = measured.withColumn("residual", residual).groupBy((F.col("residual") >= 0).alias("above")).agg(
        Summarizer.sum(F.col("features"), F.abs("residual")).alias("g"), F.sum(F.abs("residual")).alias("g0"),
        F.sum("w").alias("w"), F.sum(F.col("w") * loss).alias("loss"),
    ).collect()
    total = sum(r["w"] for r in sides)
    signs = [1 if r["above"] else -1 for r in sides]
    slope = sum(s * r["g"].toArray() for s, r in zip(signs, sides)) / total
    return total, sum(r["loss"] for r in sides) / total, slope, sum(s * r["g0"] for s, r in zip(signs, sides)) / total


def logistic_certificate(rows, model, penalty, weight=None, label="class"):
    """How near a fit is to the minimum of its penalised loss.

    ``loss`` and ``flat_loss`` are those of the model and of the best constant; ``gradient`` is the
    length of the gradient at the model as a share of its length at that constant: 0 at the minimum.
    """
    _, loss, slope, height = _loss_and_gradient(rows, margin(model), weight, label)
    weights = F.sum(F.col(weight).cast("double") if weight else F.lit(1.0))
    sums = {bool(r[0]): r[1] for r in rows.groupBy(F.col(label) == 1).agg(weights).collect()}
    constant = F.lit(math.log(sums[True] / sums[False]))
    _, flat_loss, flat_slope, flat_height = _loss_and_gradient(rows, constant, weight, label)
    own = model.coefficients.toArray()
    now = np.append(slope + penalty * own, height)
    return {
        "loss": loss + penalty * float(own @ own) / 2,
        "flat_loss": flat_loss,
        "gradient": float(np.linalg.norm(now) / np.linalg.norm(np.append(flat_slope, flat_height))),
    }


def is_certified(rows, model, penalty, weight=None):
    """Whether a fitted model, of either kind, passes its certificate over its training rows."""
    if hasattr(model, "trees"):
        deviation = forest_certificate(rows, model, weight).agg(F.avg("deviation")).first()[0]
        loss, flat_loss = forest_loss(rows, model, weight)
        return loss < flat_loss and deviation <= MOST_DEVIATION
    found = logistic_certificate(rows, model, penalty, weight)
    return found["loss"] <= found["flat_loss"] and found["gradient"] <= MOST_GRADIENT


def forest_loss(rows, model, weight=None, label="class"):
    """(log loss of the forest over the rows, that of the best constant).

    On its own training rows a forest does better than any constant; one that was fitted on other
    labels does worse, as its probabilities vary for nothing.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = model.copy().setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("")
    scored = own.transform(rows.select("features", F.col(label).cast("double").alias("y"), w.alias("w")))
    p = F.greatest(F.lit(LEAST_SHARE), F.least(F.lit(1 - LEAST_SHARE), vector_to_array("p")[1]))
    loss = -F.log(F.when(F.col("y") == 1, p).otherwise(1 - p))
    row = scored.agg(
        (F.sum(F.col("w") * loss) / F.sum("w")).alias("loss"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("share")
    ).first()
    share = row["share"]
    return row["loss"], -(share * math.log(share) + (1 - share) * math.log(1 - share))


def _print():
    return F.xxhash64(vector_to_array("features"))


def _leaf_shares(rows, model, prints):
    """(tree, leaf, p): the fraud that the trees see in the leaves of the few vectors with these prints."""
    def routed(df, item):
        number, tree = item
        own = tree.copy().setLeafCol(f"leaf{number}").setProbabilityCol(f"p{number}")
        return own.setRawPredictionCol("").setPredictionCol("").transform(df)

    few = rows.select("features").withColumn("print", _print()).join(F.broadcast(prints), "print", "left_semi")
    # Stored, so that no tree is walked before the rows are few; equal vectors are in the same leaves.
    few = written(few.groupBy("print", vector_to_array("features").alias("values")).agg(F.count(F.lit(1)).alias("n")), "leaf-vectors")
    wide = reduce(routed, enumerate(model.trees), few.select(array_to_vector("values").alias("features")))
    places = F.array(*(
        F.struct(F.lit(i).alias("tree"), F.col(f"leaf{i}").alias("leaf"), vector_to_array(f"p{i}")[1].alias("p"))
        for i in range(len(model.trees))
    ))
    return wide.select(F.inline(places)).groupBy("tree", "leaf").agg(F.max("p").alias("p"))


def forest_certificate(rows, model, weight=None, label="class"):
    """(tree, leaves, rows, deviation) per tree of a random forest over its training rows.

    ``deviation`` is the mean over leaves of the squared difference between the weighted fraud of the
    leaf's rows and what the tree says of them, in units of the variance that drawing these rows anew
    would give. A tree that was fitted on a draw of these rows has a deviation of about 1; one that
    was fitted on other labels has found structure that is not there, and has far more.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = model.copy().setLeafCol("leaves").setProbabilityCol("").setRawPredictionCol("").setPredictionCol("")
    narrow = rows.select("features", (F.col(label) == 1).cast("double").alias("y"), w.alias("w"))
    placed = own.transform(narrow.withColumn("print", _print()))
    each = placed.select("y", "w", "print", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    # What a leaf says is one number, so sums by class are enough; one vector of each leaf tells it below.
    fraud = F.col("y") == 1
    leaves = written(each.groupBy("tree", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.min("print").alias("print"),
        *(F.sum(F.when(side, value).otherwise(0.0)).alias(f"{name}{k}")
          for k, side in enumerate((~fraud, fraud)) for name, value in (("w", F.col("w")), ("s", F.col("w") * F.col("w")))),
    ), "leaves")
    told = leaves.join(_leaf_shares(rows, model, leaves.select("print").distinct()), ["tree", "leaf"])
    p = F.col("p")
    leaves = told.select(
        "tree", "n", (F.col("w1") * (1 - p) - F.col("w0") * p).alias("off"),
        (F.col("s1") * (1 - p) * (1 - p) + F.col("s0") * p * p).alias("spread"),
    )
    # Rows of a leaf that all are as the tree says have no spread, and nothing is off.
    deviation = F.coalesce(F.try_divide(F.col("off") * F.col("off"), F.col("spread")), F.lit(0.0))
    return leaves.groupBy("tree").agg(
        F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("rows"), F.avg(deviation).alias("deviation")
    )
