import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from txrisk.operators import cleaning, features, keys, metrics, profiling, reports, sampling
from txrisk.functions import text
from txrisk.schemas import LABELED_COLUMNS, RAW_TRANSACTIONS

TIME = "2019-05-04 10:20:30"


def raw_row(id=1, date=TIME, amount="$1.00", **more):
    cells = dict(
        id=id, date=date, client_id=1, card_id=2, amount=amount, use_chip="Chip", merchant_id=3,
        merchant_city="Town", merchant_state="CA", zip="12345.0", mcc=5411, errors=None,
    )
    cells.update(more)
    return tuple(cells.values())


def clean(spark, *rows):
    return cleaning.clean_transactions(spark.createDataFrame(list(rows), RAW_TRANSACTIONS))


@pytest.mark.parametrize(
    "amount, expected",
    [("$1,234.50", 1234.5), ("$0", 0.0), (" 7 ", 7.0), ("abc", None), ("NaN", None), ("$-5.00", None), (None, None)],
)
def test_amounts(spark, amount, expected):
    rows = clean(spark, raw_row(amount=amount)).collect()
    assert [r["amount"] for r in rows] == ([] if expected is None else [expected])


def test_cells_are_tidied(spark):
    row = clean(
        spark,
        raw_row(use_chip="  ", merchant_city=" A ", merchant_state=" ", zip=" 58523.0 ", errors=" "),
    ).first()
    assert row["use_chip"] == "Unknown" and row["merchant_city"] == "A"
    assert row["merchant_state"] is None and row["errors"] is None and row["zip"] == "58523"
    assert row["transaction_time"] == dt.datetime(2019, 5, 4, 10, 20, 30)
    assert row["transaction_year"] == 2019


def test_unusable_rows_are_dropped_and_copies_kept_once(spark):
    kept = clean(
        spark,
        raw_row(id=None), raw_row(date="2019-13-01 00:00:00"), raw_row(date=None),
        raw_row(id=5, amount="$3.00"), raw_row(id=5, amount="$2.00"), raw_row(id=5, amount="$2.00"),
    ).collect()
    assert [(r["transaction_id"], r["amount"]) for r in kept] == [(5, 2.0)]


def test_kept_copy_does_not_depend_on_partitioning(spark):
    rows = [raw_row(id=i % 20, amount=f"${i}.00") for i in range(200)]
    raw = spark.createDataFrame(rows, RAW_TRANSACTIONS)
    results = [
        sorted(map(tuple, cleaning.clean_transactions(raw.repartition(n)).collect())) for n in (1, 3, 7)
    ]
    assert results[0] == results[1] == results[2]


def test_labels(spark):
    words = [(1, " yes "), (1, "YES"), (2, "NO"), (3, "maybe"), (None, "Yes"), (4, None)]
    raw = spark.createDataFrame(words, "transaction_id BIGINT, label STRING")
    cleaning.require_consistent_labels(raw)
    assert sorted(map(tuple, cleaning.clean_labels(raw).collect())) == [(1, 1), (2, 0)]
    torn = raw.unionByName(spark.createDataFrame([(2, "Yes")], raw.schema))
    with pytest.raises(ValueError, match="1 transaction"):
        cleaning.require_consistent_labels(torn)


def test_labeled_layout(views):
    assert tuple(views.labeled.columns) == LABELED_COLUMNS


def test_empty_tables_give_nulls_and_zeros(spark):
    raw = spark.createDataFrame([], RAW_TRANSACTIONS)
    labels = spark.createDataFrame([], "transaction_id BIGINT, class INT")
    cleaned = cleaning.clean_transactions(raw)
    coverage = profiling.join_coverage(cleaned, labels).first()
    assert coverage["clean_transactions"] == 0 and coverage["coverage_percentage"] is None
    assert keys.surplus_duplicates(raw, "id").first()[0] == 0
    assert profiling.amount_statistics(cleaned).first()["mean"] is None
    assert profiling.class_distribution(labels).count() == 0


def test_duplicates_ignore_null_ids(spark):
    ids = spark.createDataFrame([(None,), (None,), (1,), (1,), (1,), (2,)], "id BIGINT")
    assert keys.surplus_duplicates(ids, "id").first()[0] == 2
    assert keys.duplicated_keys(ids, "id").first()[0] == 2


def test_split_arguments(spark):
    df = spark.range(10).withColumnRenamed("id", "transaction_id")
    for fraction in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            sampling.split(df, fraction)
    with pytest.raises(ValueError):
        sampling.cap_rows(df, 0)
    with pytest.raises(ValueError):
        sampling.undersample(df.withColumn("class", F.lit(0)), ratio=0)
    with pytest.raises(ValueError):
        sampling.tree_rows(df, 0)
    assert sampling.cap_rows(df, 10).count() == 10
    assert sampling.undersample(df.withColumn("class", F.lit(0))).count() == 0
    assert sampling.undersample(df.withColumn("class", F.lit(1))).count() == 10


def test_shares_far_below_a_millionth_can_be_told(spark):
    from txrisk.functions.hashing import FINE, hash_share, share_bound, xxhash_bucket, xxhash_place

    bounds = spark.range(1).select(share_bound(1e-9).alias("a"), share_bound(2e-9).alias("b"), share_bound(0.8).alias("c"))
    a, b, c = bounds.first()
    assert 0 < a < b and a == pytest.approx(1e-9 * 1_000_000 * FINE, rel=1e-3) and c == 800_000 * FINE
    ids = spark.range(300_000)
    assert ids.where(hash_share("id", 42, 0.8) != (xxhash_bucket("id", 42) < 800_000)).count() == 0
    few = ids.where(hash_share("id", 7, 1e-4)).select(xxhash_place("id", 7).alias("p"))
    assert 10 < few.count() < 60 and few.where(F.col("p") >= share_bound(1e-4)).count() == 0


def test_split_is_a_partition_and_repeatable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "transaction_id")
    parts = sampling.three_way_split(df)
    ids = {name: {r[0] for r in part.collect()} for name, part in parts.items()}
    assert sum(map(len, ids.values())) == 20_000 and len(set.union(*ids.values())) == 20_000
    assert abs(len(ids["train"]) / 20_000 - 0.6) < 0.02
    again = sampling.three_way_split(df.repartition(5))["test"]
    assert {r[0] for r in again.collect()} == ids["test"]
    named = sampling.with_split_name(df).where("split = 'validation'")
    assert {r["transaction_id"] for r in named.collect()} == ids["validation"]


def test_undersampling_keeps_all_fraud(spark):
    df = spark.range(10_000).select(
        F.col("id").alias("transaction_id"), (F.col("id") % 100 == 0).cast("int").alias("class")
    )
    counts = {r["class"]: r["count"] for r in sampling.undersample(df).groupBy("class").count().collect()}
    assert counts[1] == 100 and 850 < counts[0] < 1150


def test_tree_rows_come_from_the_whole_table(spark):
    df = spark.range(200_000).withColumnRenamed("id", "transaction_id")
    dealt = sampling.tree_rows(df, 20, 256)
    sizes = dealt.groupBy("tree").agg(F.count("*"), F.min("transaction_id"), F.max("transaction_id")).collect()
    assert len(sizes) == 20 and all(850 < r[1] < 1200 and r[2] < 4_000 and r[3] > 196_000 for r in sizes)
    assert sampling.tree_rows(df.limit(30), 4, 256).count() == 120


def test_tree_samples_spread_when_all_rows_share_a_bucket(spark):
    from txrisk.functions.hashing import FINE, xxhash_place

    def one_bucket(key, seed):
        return xxhash_place(key, seed) % F.lit(FINE) + F.lit(5 * FINE)

    df = spark.range(20_000).withColumnRenamed("id", "transaction_id")
    dealt = sampling.tree_rows(df, 3, 256, place=one_bucket)
    for tree in range(3):
        ids = [r[0] for r in dealt.where(F.col("tree") == tree).orderBy("draw").limit(256).select("transaction_id").collect()]
        assert len(ids) == 256 and min(ids) < 500 and max(ids) > 19_500 and 8_500 < sum(ids) / 256 < 11_500


def scored_frame(spark, rows):
    return spark.createDataFrame([("m", float(s), c) for s, c in rows], "slug STRING, score DOUBLE, class INT")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30).map(lambda n: n / 30), st.integers(0, 1)), min_size=2, max_size=60))
def test_area_under_pr_is_mllibs(spark, rows):
    if not any(c for _, c in rows):
        rows = [*rows, (0.5, 1)]
    df = scored_frame(spark, rows)
    ours = metrics.area_under_pr(df, "score", digits=1).first()["pr_auc"]
    theirs = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="class", metricName="areaUnderPR", numBins=0
    ).evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_area_under_pr_edges(spark):
    same = scored_frame(spark, [(0.5, 1), (0.5, 0), (0.5, 0)])
    assert metrics.area_under_pr(same, "score").first()["pr_auc"] == pytest.approx(1 / 3)
    none = scored_frame(spark, [(0.5, 0), (0.1, 0)])
    assert metrics.area_under_pr(none, "score").first()["pr_auc"] == 0.0


def test_threshold_sweep_by_hand(spark):
    df = scored_frame(spark, [(0.2, 1), (0.5, 0), (0.5, 1), (0.9, 1), (0.1, 0)])
    rows = {r["threshold"]: r for r in metrics.threshold_sweep(df, "score", (0.0, 0.5, 1.0)).collect()}
    assert tuple(rows[0.5][c] for c in metrics.COUNTS) == (2, 1, 1, 1)
    assert tuple(rows[0.0][c] for c in metrics.COUNTS) == (3, 0, 2, 0)
    assert rows[1.0]["precision"] == 0.0 and rows[1.0]["recall"] == 0.0 and rows[1.0]["f1"] == 0.0
    assert rows[0.5]["f1"] == pytest.approx(2 / 3)
    for bad in ((), (1.5,), (-0.1,)):
        with pytest.raises(ValueError):
            metrics.threshold_sweep(df, "score", bad)


def test_threshold_ties_go_to_the_higher_threshold(spark):
    df = scored_frame(spark, [(0.9, 1), (0.1, 0)])
    best = metrics.select_thresholds(metrics.threshold_sweep(df, "score", (0.3, 0.6, 0.2))).first()
    assert best["threshold"] == 0.6 and best["f1"] == 1.0


def test_pr_curve_starts_at_one(spark):
    df = scored_frame(spark, [(1.0, 1), (0.0, 0)])
    rows = [tuple(r) for r in metrics.pr_curve(df, "score", 10, label="class").orderBy(F.desc("threshold")).collect()]
    assert rows == [("m", 1.0, 1.0, 0.0), ("m", 0.9, 1.0, 1.0), ("m", 0.0, 0.5, 1.0)]


def test_histogram_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 10.0, 10.5, -1.0, None)], "x DOUBLE")
    rows = reports.histogram(df, "x", 5, 0.0, 10.0).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0, 1]
    assert rows[4]["upper"] == 10.0 and rows[0]["center"] == 1.0
    for bins, low, high in ((0, 0, 1), (5, 1, 1), (5, 2, 1)):
        with pytest.raises(ValueError):
            reports.histogram(df, "x", bins, low, high)
    with pytest.raises(ValueError):
        reports.clipped_histogram(df.where("x > 99"), "x", 5, 0.0, 1.0)


def test_search(spark):
    df = spark.createDataFrame(
        [(12, dt.datetime(2019, 1, 2), 0.9), (34, dt.datetime(2020, 3, 4), 0.1), (56, None, None)],
        "transaction_id BIGINT, transaction_time TIMESTAMP, fraud_probability DOUBLE",
    )
    ids = lambda *a: {r["transaction_id"] for r in reports.search_suspicious(df, *a).collect()}
    assert ids() == {12, 34, 56} and ids("2020-03") == {34} and ids("", 0.5) == {12} and ids("12") == {12}


def test_iso_times(spark):
    cases = {
        "2019-12-31T13:05:00Z": 13, "2019-12-31 13:05:00": 13, "2019-12-31T13:05:00.25+07:00": 13,
        "2019-12-31": 0, "2019-12-31T23:05": 23, "2019": None, "13:05": None, "2019-02-30": None, "": None, None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t STRING")
    found = {r["t"]: r["h"] for r in df.select("t", F.hour(text.iso_timestamp("t")).alias("h")).collect()}
    assert found == cases


def test_features_by_hand(spark):
    rows = spark.createDataFrame(
        [(1, dt.datetime(2019, 5, 5, 23, 0), 9.0, None, " ", None, " x ")],
        "transaction_id BIGINT, transaction_time TIMESTAMP, amount DOUBLE, use_chip STRING, "
        "merchant_state STRING, mcc INT, errors STRING",
    )
    row = features.inference_features(rows).first()
    assert row["transaction_day_of_week"] == 1.0 and row["is_weekend"] == 1.0
    assert row["transaction_hour"] == 23.0 and row["is_online"] == 1.0 and row["has_error"] == 1.0
    assert (row["use_chip"], row["mcc_category"], row["merchant_state_category"]) == (
        "Unknown", "Unknown", "ONLINE_OR_UNKNOWN",
    )
