"""Repeatable splits and samples by hashed id, and class weights.

Everything is a row filter by :func:`txrisk.functions.hashing.hash_share`: no shuffle of rows, no
dependence on partitioning or row order. Row and class counts stay in the plan as scalars or as a
table of classes; none is passed in by the caller.
"""

from pyspark.sql import functions as F

from txrisk.functions.hashing import hash_share, share_bound, xxhash_place
from txrisk.settings import (
    CAP_SEED,
    FOREST_SAMPLE,
    FOREST_SEED,
    SPLIT_SEED,
    TRAIN_FRACTION_OF_POOL,
    TRAIN_POOL_FRACTION,
    UNDERSAMPLE_RATIO,
    UNDERSAMPLE_SEED,
    VALIDATION_SEED,
)

ID = "transaction_id"
PARTS = ("train", "validation", "test")


def _require(sound, message):
    if not sound:
        raise ValueError(message)


def row_count(df):
    """The number of rows as a scalar column."""
    return df.agg(F.count(F.lit(1))).scalar()


def split(df, fraction=TRAIN_POOL_FRACTION, seed=SPLIT_SEED, place=xxhash_place):
    """(first, second): ``fraction`` of the ids, and the others."""
    _require(0.0 < fraction < 1.0, "fraction must lie between 0 and 1")
    first = hash_share(ID, seed, fraction, place)
    return df.where(first), df.where(~first)


def part_name(place=xxhash_place):
    """Which of ``PARTS`` a row belongs to, as a column: 60, 20 and 20 of 100."""
    pooled = hash_share(ID, SPLIT_SEED, TRAIN_POOL_FRACTION, place)
    taught = hash_share(ID, VALIDATION_SEED, TRAIN_FRACTION_OF_POOL, place)
    return F.when(~pooled, PARTS[2]).when(~taught, PARTS[1]).otherwise(PARTS[0])


def with_split_name(df, place=xxhash_place):
    return df.withColumn("split", part_name(place))


def three_way_split(df, place=xxhash_place):
    """{part: its rows}; each part is one filter over the same table."""
    return {name: df.where(part_name(place) == name) for name in PARTS}


def split_fractions(df, place=xxhash_place):
    """(split, rows, fraction): what the hash really gave each part."""
    rows = with_split_name(df, place).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    whole = rows.agg(F.sum("rows")).scalar()
    return rows.withColumn("fraction", F.round(F.try_divide("rows", whole), 8))


def cap_rows(df, target, seed=CAP_SEED, place=xxhash_place):
    """About ``target`` rows whatever their class; all rows if there are no more than that."""
    _require(target > 0, "target must be positive")
    share = F.least(F.lit(1.0), F.try_divide(F.lit(float(target)), row_count(df)))
    return df.where(hash_share(ID, seed, share, place))


def class_shares(df, ratio=UNDERSAMPLE_RATIO):
    """(class, share): all fraud, and of the normal rows about ``ratio`` for each fraud row."""
    _require(ratio > 0, "ratio must be positive")
    counts = df.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
    fraud = F.coalesce(counts.where(F.col("class") == 1).agg(F.sum("rows")).scalar(), F.lit(0))
    thin = F.least(F.lit(1.0), fraud * F.lit(float(ratio)) / F.col("rows"))
    return counts.select("class", F.when(F.col("class") == 1, 1.0).otherwise(thin).alias("share"))


def undersample(df, ratio=UNDERSAMPLE_RATIO, seed=UNDERSAMPLE_SEED, place=xxhash_place):
    """All fraud rows and about ``ratio`` normal rows for each."""
    # Two classes, so two rows: the broadcast has a fixed size.
    shares = F.broadcast(class_shares(df.where(F.col("class").isin(0, 1)), ratio))
    chosen = df.join(shares, "class").where(hash_share(ID, seed, F.col("share"), place))
    return chosen.select(*df.columns)


def tree_rows(df, trees, sample_size=FOREST_SAMPLE, seed=FOREST_SEED, place=xxhash_place, key=ID):
    """``df`` with (tree, draw): for each tree about four samples' worth of rows of the whole table.

    A tree's sample are the ``sample_size`` rows with its smallest draws. Rows pass twice, once by
    themselves and once with each tree, so that only few rows of a large table meet all trees; in a
    small table all pass. A tree draws every row with the same probability, whatever its id.
    """
    _require(trees > 0 and sample_size > 0, "trees and sample_size must be positive")
    total = row_count(df)
    each = F.least(F.lit(1.0), F.try_divide(F.lit(4.0 * sample_size), total))
    some = F.least(F.lit(1.0), each * F.lit(float(trees)))
    drawn = df.where(hash_share(key, seed, some, place)).withColumn("some_share", each / some)

    def of_tree(tree):
        return F.struct(tree.alias("tree"), place(key, F.concat_ws(":", F.lit(str(seed)), tree)).alias("draw"))

    numbered = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), of_tree)
    dealt = drawn.select("*", F.inline(numbered))
    return dealt.where(F.col("draw") < share_bound(F.col("some_share"))).drop("some_share")


def class_weights(df):
    """(class, rows, weight): weight is all rows / (2 * rows of the class)."""
    rows = df.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
    whole = rows.agg(F.sum("rows")).scalar()
    return rows.withColumn("weight", whole / (2.0 * F.col("rows")))


def with_class_weight(df, normal_weight, fraud_weight):
    weight = F.when(F.col("class") == 1, float(fraud_weight)).otherwise(float(normal_weight))
    return df.withColumn("class_weight", weight)
