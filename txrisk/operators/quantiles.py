"""Exact quantiles by distributed selection.

Every number has a whole-number key that sorts like it: its binary form. Counts per leading bits of
the keys tell in which block of numbers a rank lies; the next round counts the next bits of the
keys inside that block, until a block holds a single number. Four rounds of 16 bits settle any
double. The keys are stored once; a round is one aggregation over them, folded in the map tasks to
at most 65,536 blocks for each block still open, and only one row per wanted rank reaches the driver.
"""

import math
import struct

from pyspark.sql import Window, functions as F

from txrisk.session import written

BITS = 16


def sort_key(column):
    """The bits of a double as a number that sorts like it; null for null and NaN."""
    value = column.cast("double")
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    # The logarithm may be rounded across a power of two.
    power = guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).when(size < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    normal = (power + 1023) * F.lit(1 << 52) + (
        (size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(1 << 52))
    ).cast("bigint")
    bits = (
        F.when(size == float("inf"), F.lit(2047 << 52))
        .when(size >= 2.0**-1022, normal)
        .otherwise((size / F.lit(5e-324)).cast("bigint"))
    )
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(value < 0, -bits).otherwise(bits))


def number_of(key):
    """The double with this key."""
    size = struct.unpack(">d", struct.pack(">q", abs(key)))[0]
    return -size if key < 0 else size


def rank_of(fraction, rows):
    """The rank, from 1, that the fraction stands for: the first with at least that share of rows."""
    return max(1, rows - math.floor(rows - fraction * rows))


def _block_of(keys, ranks, shift):
    """[(block, rank inside it, smallest key, largest key)] of each open (block, rank).

    ``None`` stands for all keys.
    """
    around = F.lit(0) if ranks[0][0] is None else F.shiftright("key", shift + BITS)
    if ranks[0][0] is not None:
        keys = keys.where(around.isin(sorted({block for block, _ in ranks})))
    counts = keys.groupBy(around.alias("outer"), F.shiftright("key", shift).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    below = Window.partitionBy("outer").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(block or 0).cast("bigint").alias("of"), F.lit(rank).cast("bigint").alias("rank"))
        for i, (block, rank) in enumerate(ranks)
    ])
    hit = F.filter(wanted, lambda w: (w["of"] == F.col("outer")) & w["rank"].between(F.col("before") + 1, F.col("before") + F.col("n")))
    found = placed.select("*", F.inline(hit)).collect()  # one row for each rank
    return [(r["block"], r["rank"] - r["before"], r["low"], r["high"]) for r in sorted(found, key=lambda r: r["i"])]


def exact_quantiles(df, column, fractions):
    """The value at each fraction of the sorted column, as ``quantile_disc`` has it; None without values.

    Nulls and NaN do not count. Numbers are taken as doubles.
    """
    fractions = list(fractions)
    if any(not 0.0 <= f <= 1.0 for f in fractions):
        raise ValueError(f"fractions must lie in [0, 1]: {fractions}")
    keys = written(df.select(sort_key(F.col(column)).alias("key")).where("key IS NOT NULL"), "quantile-keys")
    rows = keys.count()
    if not rows:
        return [None] * len(fractions)
    values = [None] * len(fractions)
    open_ranks = {i: (None, rank_of(f, rows)) for i, f in enumerate(fractions)}
    for shift in range(64 - BITS, -1, -BITS):
        found = _block_of(keys, list(open_ranks.values()), shift)
        for i, (block, rank, low, high) in zip(list(open_ranks), found):
            open_ranks[i] = block, rank
            if low == high:
                values[i] = number_of(low)
                del open_ranks[i]
        if not open_ranks:
            break
    return values
