"""Exact quantiles against sorting, on numbers of all kinds and sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from txrisk.operators import profiling, quantiles, reports

FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def by_sorting(values, fraction):
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    return kept[quantiles.rank_of(fraction, len(kept)) - 1] if kept else None


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x DOUBLE").repartition(7)


def test_keys_sort_like_their_numbers(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, math.inf, -math.inf, 1.0, 2.0]
    numbers += [math.ldexp(1, e) for e in range(-1074, 1024, 13)]
    numbers += [math.nextafter(math.ldexp(1, e), way) for e in range(-1000, 1000, 17) for way in (0, math.inf)]
    numbers += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(500)]
    rows = table(spark, numbers).select("x", quantiles.sort_key(F.col("x")).alias("key")).collect()
    assert all(quantiles.number_of(r.key) == r.x for r in rows)
    ordered = sorted(rows, key=lambda r: r.key)
    assert [r.x for r in ordered] == sorted(r.x for r in rows)
    assert table(spark, [None, math.nan]).select(quantiles.sort_key(F.col("x")).alias("k")).where("k IS NOT NULL").count() == 0


@pytest.mark.parametrize("values", [
    [], [None, math.nan], [3.5], [1.0] * 900 + [2.0] * 100,
    [None, math.nan, -1.0, 1.0, -0.5, math.inf, -math.inf],
    [1.0 + k * 2.0**-52 for k in range(300)],  # told apart by their last bits only
])
def test_quantiles_equal_sorting(spark, values):
    found = quantiles.exact_quantiles(table(spark, values), "x", FRACTIONS)
    assert found == [by_sorting(values, f) for f in FRACTIONS]


def test_many_numbers_of_all_sizes(spark):
    rng = random.Random(2)
    values = [math.exp(rng.gauss(3, 4)) * rng.choice((1, 1, -1)) for _ in range(5000)] + [7.25] * 2500
    assert quantiles.exact_quantiles(table(spark, values), "x", FRACTIONS) == [by_sorting(values, f) for f in FRACTIONS]


def test_beyond_any_sketch(spark):
    """Ranks that a sketch of a million entries would miss: neighbours of a rank are all different."""
    rows = 3_000_000
    df = spark.range(rows).select(((F.col("id") * 7919) % rows + 0.5).alias("x"))
    assert quantiles.exact_quantiles(df, "x", (0.25, 0.5, 0.99)) == [749_999.5, 1_499_999.5, 2_969_999.5]


def test_rounds_are_grouped_counts(spark):
    """Counts fold before the shuffle, and one row for each rank reaches the driver."""
    keys = spark.range(1000).select(F.col("id").alias("key"))
    seen = []
    inner = type(keys).collect
    try:
        type(keys).collect = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or inner(df)
        found = quantiles._block_of(keys, [(None, 10), (None, 900)], 0)
    finally:
        type(keys).collect = inner
    assert [b for b, _, _, _ in found] == [9, 899] and len(seen) == 1 and "partial_count" in seen[0]
    assert "partial_count" in seen[0].split("Window")[1]  # the window runs over counts, not over keys


def test_statistics_and_bounds(spark):
    df = table(spark, [float(i) for i in range(1, 101)]).withColumnRenamed("x", "amount")
    row = profiling.amount_statistics(df).first()
    assert (row["min"], row["q25"], row["q50"], row["q75"], row["max"]) == (1.0, 25.0, 50.0, 75.0, 100.0)
    assert reports.quantile_bounds(df, "amount", 0.01, 0.99) == (1.0, 99.0)
    with pytest.raises(ValueError, match="no values"):
        reports.clipped_histogram(df.limit(0), "amount", 10, 0.01, 0.99)
    with pytest.raises(ValueError, match="fractions"):
        quantiles.exact_quantiles(df, "amount", (1.5,))
