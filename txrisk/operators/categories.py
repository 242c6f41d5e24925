"""A category dictionary that no driver holds, and the preprocessor's vectors built from it.

``StringIndexer`` brings every label to the driver. Here the dictionary is a table: values of each feature
ranked from most to least frequent, ties by value, through a range sort whose parts are numbered
and then shifted by the counts of the parts before. Rows meet it in joins, which Spark broadcasts
for small dictionaries and otherwise shuffles and splits where a value is hot. Slots, vector
positions and scaled entries are those of the MLlib preprocessor, so both agree wherever MLlib can
be used.
"""

from pyspark.sql import Window, functions as F

from txrisk.session import written
from txrisk.settings import CATEGORICAL_FEATURES, NUMERIC_FEATURES


def numbered(rows, group, *order):
    """``rows`` with ``place``, from 0, by ``order`` in their ``group``; no task holds a group.

    The sorted parts are stored, so that the numbers given to a part's rows stay with them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    stored = written(ordered.withColumn("at", F.monotonically_increasing_id()), "numbered")
    stored = stored.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored.groupBy(group, "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n")).select(
        group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift")
    )
    placed = stored.join(written(runs, "numbered-runs"), [group, "part"])
    return placed.withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _pairs(features, columns):
    """(feature, value) of every row and category column."""
    both = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))
    return features.select(F.inline(both))


def category_dictionary(features, columns=CATEGORICAL_FEATURES):
    """Stored (feature, value, n, slot): values by falling count, then by value. Nulls have no slot."""
    counts = _pairs(features, columns).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = numbered(counts, "feature", F.desc("n"), "value")
    return written(ranked.withColumnRenamed("place", "slot"), "categories")


def category_widths(dictionary, columns=CATEGORICAL_FEATURES):
    """{column: positions it takes}: one for each value and one for unseen values. Bounded by the columns."""
    found = dict(dictionary.groupBy("feature").agg(F.count(F.lit(1)) + 1).collect())
    return {c: found.get(c, 1) for c in columns}


def with_slots(features, dictionary, columns=CATEGORICAL_FEATURES):
    """Adds ``<column>_slot``; values the dictionary does not know have the slot after the last."""
    widths = category_widths(dictionary, columns)
    for c in columns:
        own = dictionary.where(F.col("feature") == c).select(
            F.col("value").alias(f"{c}_value"), F.col("slot").alias(f"{c}_slot")
        )
        joined = features.join(own, F.col(c).cast("string") == F.col(f"{c}_value"), "left").drop(f"{c}_value")
        features = joined.withColumn(f"{c}_slot", F.coalesce(f"{c}_slot", F.lit(widths[c] - 1)))
    return features


def vector_starts(widths, numbers=NUMERIC_FEATURES):
    """{column: position in the vector where its slots begin}."""
    starts, at = {}, len(numbers)
    for c, width in widths.items():
        starts[c], at = at, at + width
    return starts


def entry_scales(train, dictionary, numbers=NUMERIC_FEATURES, columns=CATEGORICAL_FEATURES):
    """Stored (position, deviation): the sample deviation of every vector position over ``train``.

    That of a slot follows from its count, so no vector is built for it.
    """
    starts = vector_starts(category_widths(dictionary, columns), numbers)
    row = train.agg(F.count(F.lit(1)).alias("rows"), *(F.stddev_samp(c).alias(c) for c in numbers)).first()
    spark, total = train.sparkSession, float(row["rows"])
    small = spark.createDataFrame(
        [(i, row[c]) for i, c in enumerate(numbers)], "position BIGINT, deviation DOUBLE"
    )
    start = F.coalesce(*(F.when(F.col("feature") == c, F.lit(at)) for c, at in starts.items()))
    n = F.col("n").cast("double")
    slots = dictionary.select(
        (start + F.col("slot")).cast("bigint").alias("position"),
        F.sqrt(F.try_divide(n * (total - n), F.lit(total * (total - 1)))).alias("deviation"),
    )
    return written(small.unionByName(slots), "entry-scales")


def sparse_entries(features, dictionary, numbers=NUMERIC_FEATURES, columns=CATEGORICAL_FEATURES):
    """(transaction_id, position, value): the assembled vector's entries other than zero."""
    starts = vector_starts(category_widths(dictionary, columns), numbers)
    entries = [
        *(F.struct(F.lit(i).cast("bigint").alias("position"), F.col(c).cast("double").alias("value"))
          for i, c in enumerate(numbers)),
        *(F.struct((F.col(f"{c}_slot") + starts[c]).alias("position"), F.lit(1.0).alias("value")) for c in columns),
    ]
    slotted = with_slots(features, dictionary, columns)
    return slotted.select("transaction_id", F.inline(F.array(*entries))).where(F.col("value") != 0)


def scaled_entries(entries, scales):
    """The entries divided by their position's deviation; constant positions are zero and left out."""
    kept = scales.where(F.col("deviation") > 0)
    return entries.join(kept, "position").select(
        "transaction_id", "position", (F.col("value") / F.col("deviation")).alias("value")
    )
