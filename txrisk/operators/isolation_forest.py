"""Isolation forest (Liu, Ting and Zhou, 2008): trees grown on executors, rows scored in Arrow
batches.

A forest is a table of nodes (tree, node, feature, threshold, left, right, path, sample_size).
Leaves have feature -1 and carry the path length they stand for.
"""

import math
import sys
from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from txrisk.settings import (
    FOREST_SAMPLE,
    FOREST_SEED,
    FOREST_TREES,
    MAX_FOREST_NODES,
    NUMERIC_FEATURES,
)
from txrisk.operators.sampling import tree_rows

# The few functions that run inside tasks travel with them: executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

NODES = (
    "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, path DOUBLE, "
    "sample_size INT"
)


def average_path(n):
    """Expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + float(np.euler_gamma)) - 2.0 * (n - 1.0) / n


def grow_tree(points, rng):
    """Random axis cuts of at most a few hundred points, breadth first, as node tuples."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes, queue = [], [(points, 0)]
    for part, depth in queue:  # grows while it is walked
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(varying) == 0:
            me = len(nodes)
            nodes.append((-1, 0.0, me, me, depth + average_path(len(part))))
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = part[:, feature] <= cut
        if left.all():  # rounding put the cut on the upper edge
            cut = float(low[feature])
            left = part[:, feature] <= cut
        first_child = len(queue)
        nodes.append((feature, cut, first_child, first_child + 1, 0.0))
        queue += [(part[left], depth + 1), (part[~left], depth + 1)]
    return nodes


def fit_forest(
    train,
    trees=FOREST_TREES,
    sample_size=FOREST_SAMPLE,
    seed=FOREST_SEED,
    columns=NUMERIC_FEATURES,
    key="transaction_id",
):
    """Node table of a forest; each tree samples the whole table. Labels are never looked at."""
    if train.isEmpty():
        raise ValueError("cannot fit a forest on no rows")
    columns = list(columns)
    dealt = tree_rows(train.select(key, *columns), trees, sample_size, seed, key=key)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        sample = pdf.nsmallest(sample_size, ["draw", key])
        nodes = grow_tree(sample[columns].to_numpy(float), np.random.default_rng([seed, tree]))
        table = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
        table.insert(0, "tree", tree)
        table.insert(1, "node", range(len(table)))
        table["sample_size"] = len(sample)
        return table

    return dealt.groupBy("tree").applyInPandas(grow, NODES)


class ForestScorer:
    """A fitted forest ready to score columns; holds the nodes as one broadcast.

    A forest has at most trees * (2 * sample size - 1) nodes, as its own table says; one of more
    than ``max_nodes`` (about 50 bytes each) is refused before it is collected.
    """

    def __init__(self, nodes, max_nodes=MAX_FOREST_NODES):
        held = nodes.agg(
            F.count(F.lit(1)).alias("nodes"), F.count_distinct("tree").alias("trees"), F.max("sample_size").alias("rows")
        ).first()
        bound = min(max_nodes, held["trees"] * (2 * (held["rows"] or 0) - 1))
        if not 0 < held["nodes"] <= bound:
            raise ValueError(f"forest has {held['nodes']} nodes, expected 1 to {bound}")
        table = nodes.toPandas().sort_values(["tree", "node"])
        sizes = table.groupby("tree").size()
        roots = (sizes.cumsum() - sizes).to_numpy()
        base = np.repeat(roots, sizes.to_numpy())
        arrays = {
            "roots": roots,
            "feature": table["feature"].to_numpy(),
            "threshold": table["threshold"].to_numpy(),
            "left": table["left"].to_numpy() + base,
            "right": table["right"].to_numpy() + base,
            "path": table["path"].to_numpy(),
        }
        psi = int(table["sample_size"].max())
        self.depth = math.ceil(math.log2(max(psi, 2)))
        self.norm = average_path(psi) or 1.0
        self.arrays = nodes.sparkSession.sparkContext.broadcast(arrays)

    def score(self, *columns):
        """2^(-mean path / c) - 0.5: above 0 is an outlier, higher is more so."""
        arrays, depth, norm = self.arrays, self.depth, self.norm

        @F.pandas_udf("double")
        def anomaly(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            a = arrays.value
            for batch in batches:
                points = np.column_stack([s.to_numpy(float) for s in batch])
                yield pd.Series(np.exp2(-_mean_paths(points, a, depth) / norm) - 0.5)

        return anomaly(*(columns or NUMERIC_FEATURES))


def _mean_paths(points, a, depth, chunk=2048):
    """Mean leaf path over all trees; walks all trees of a chunk of rows at once."""
    out = np.empty(len(points))
    for start in range(0, len(points), chunk):
        part = points[start:start + chunk]
        rows = np.arange(len(part))[:, None]
        at = np.broadcast_to(a["roots"], (len(part), len(a["roots"])))
        for _ in range(depth):
            value = part[rows, a["feature"][at]]
            at = np.where(value <= a["threshold"][at], a["left"][at], a["right"][at])
        out[start:start + chunk] = a["path"][at].mean(axis=1)
    return out


def score_forest(scorer, features, *carry):
    """Ids, amount, carried columns, anomaly_score and the 0/1 outlier flag."""
    scored = features.withColumn("anomaly_score", scorer.score())
    return scored.select(
        "transaction_id",
        "transaction_time",
        "amount",
        *carry,
        "anomaly_score",
        (F.col("anomaly_score") > 0).cast("int").alias("prediction"),
    )
