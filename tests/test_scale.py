"""What must hold on a large cluster: plans that stay distributed, and keys that are badly skewed."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from txrisk.catalog import aggregates, models, rows, streams, tables  # noqa: F401  (they register)
from txrisk.catalog import registry
from txrisk.catalog.tables import as_csv
from txrisk.operators import audits, cleaning, keys, metrics, profiling, reports
from txrisk.plans import train
from txrisk.schemas import RAW_TRANSACTIONS
from txrisk.sources import readers, writers

# Each builds its plan without training models or running streams first.
PLANNED = sorted(
    name
    for name in registry.QUERIES
    if not name.startswith(("ml_1", "ml_2", "ml_02", "ml_03", "ml_05", "ml_06", "str_", "snk_", "agg_28"))
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_python_row_or_global_window(spark, name):
    text = plan(registry.QUERIES[name](spark, str(DATA)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    # A window without partition columns would pull everything into one task.
    for line in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert not line.startswith("specifiedwindowframe"), line


def test_histogram_scan_reads_one_column_and_pushes_both_bounds(spark, views):
    stored = views.stored
    text = plan(reports.histogram(stored, "amount", 10, 0.0, 1000.0))
    assert "GreaterThanOrEqual(amount,0.0)" in text and "LessThanOrEqual(amount,1000.0)" in text
    assert re.search(r"ReadSchema: struct<amount:double>", text)


def test_flagged_rows_prune_partitions(spark, views, tmp_path):
    path = writers.write_table(views.predictions, str(tmp_path / "p"), "prediction")
    text = plan(reports.flagged(readers.read_table(spark, path)))
    assert re.search(r"PartitionFilters: \[isnotnull\(prediction#\d+\), \(prediction#\d+ = 1\)\]", text)


def test_split_read_prunes_partitions(spark, views, tmp_path):
    train.write_splits(views.stored, str(tmp_path / "s"))
    text = plan(train.read_split(spark, str(tmp_path / "s"), "test"))
    assert re.search(r"PartitionFilters: \[.*split#\d+ = test", text)
    with pytest.raises(ValueError):
        train.read_split(spark, str(tmp_path / "s"), "holdout")


def test_labeling_shuffles_each_side_once(spark, views):
    """The grouping by id already places rows for the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = spark.createDataFrame([], RAW_TRANSACTIONS)
        labels = spark.createDataFrame([], "transaction_id BIGINT, label STRING")
        joined = cleaning.label_transactions(cleaning.clean_transactions(raw), cleaning.clean_labels(labels))
        assert plan(joined).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k_sorts_no_whole_table(spark, views):
    assert "TakeOrderedAndProject" in plan(reports.top_suspicious(views.predictions))


def skewed(spark, n=60_000):
    """A third of all rows share one id."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        F.when(hot, 1).otherwise(F.col("id")).alias("id"),
        F.lit("2019-01-01 00:00:00").alias("date"),
        F.lit(1).cast("bigint").alias("client_id"),
        F.lit(2).cast("bigint").alias("card_id"),
        F.concat(F.lit("$"), (F.col("id") + 5).cast("string")).alias("amount"),
        F.lit("Chip").alias("use_chip"),
        F.lit(3).cast("bigint").alias("merchant_id"),
        F.lit("Town").alias("merchant_city"),
        F.lit("CA").alias("merchant_state"),
        F.lit("1.0").alias("zip"),
        F.lit(5411).alias("mcc"),
        F.lit(None).cast("string").alias("errors"),
    )


def test_hot_id_is_folded_before_the_shuffle(spark):
    raw = skewed(spark)
    cleaned = cleaning.clean_transactions(raw)
    assert cleaned.count() == 40_000
    assert cleaned.where("transaction_id = 1").first()["amount"] == 5.0 + 0
    profile = profiling.id_profile(raw).first()
    assert (profile["duplicates"], profile["valid_ids"]) == (20_000, 40_000)
    assert keys.surplus_duplicates(raw, "id").first()[0] == 20_000
    text = plan(cleaned.select("transaction_id", "amount"))
    assert "partial_min" in text  # one row per key and map task is shuffled


def test_one_score_for_a_third_of_the_rows(spark):
    rows = spark.range(0, 30_000, 1, 8).select(
        F.lit("m").alias("slug"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 30_000.0).alias("score"),
        (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).cast("int").alias("class"),
    )
    few = metrics.area_under_pr(rows, "score").first()["pr_auc"]
    many = metrics.area_under_pr(rows, "score", digits=3).first()["pr_auc"]
    assert few == pytest.approx(many, abs=1e-12) and 0.05 < few < 0.2


def test_differences_count_copies(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "x INT")
    right = spark.createDataFrame([(1,), (3,)], "x INT")
    rows = sorted(map(tuple, audits.differences(left, right).collect()))
    assert rows == [(1, "left"), (2, "left"), (3, "right")]
    assert audits.differences(left, left).count() == 0


def test_counting_clean_rows_shuffles_ids_only(spark):
    text = plan(cleaning.clean_transactions(skewed(spark)).groupBy().count())
    assert "struct(" not in text and "SortAggregate" not in text


def test_cleaning_parses_each_cell_once(spark, views):
    raw = readers.read_raw_transactions(spark, as_csv(views.raw, "raw"))
    text = plan(cleaning.clean_transactions(raw))
    assert text.count("gettimestamp") == 1 and text.count("translate(") == 1
