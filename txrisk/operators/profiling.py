"""Counts and statistics about raw, clean and labeled tables."""

from pyspark.sql import functions as F

from txrisk.functions import text
from txrisk.functions.scoring import percentage
from txrisk.operators.cleaning import usable_amount
from txrisk.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def raw_profile(raw):
    """One row, one scan: the row count and the missing cells of every column."""
    return raw.agg(
        F.count(F.lit(1)).alias("row_count"),
        *(
            F.count_if(text.is_missing(c) if kind == "string" else F.col(c).isNull()).alias(
                f"{c}_missing"
            )
            for c, kind in raw.dtypes
        ),
    )


def _ids(raw):
    """(id, copies, valid) of every raw id, null included, from one grouping of narrow rows."""
    checked = raw.select(
        "id",
        (text.timestamp("date").isNotNull() & usable_amount(text.money("amount"))).alias("valid"),
    )
    return checked.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.max("valid").alias("valid"))


def id_profile(raw):
    """One row: surplus copies of ids, and how many ids have at least one valid row.

    The second number is what cleaning must leave, found without running the cleaning itself.
    """
    return _ids(raw).where(F.col("id").isNotNull()).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count_if("valid").alias("valid_ids"),
    )


def raw_and_clean_rows(raw):
    """One row (raw_rows, clean_rows): what there is, and what cleaning leaves of it."""
    return _ids(raw).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        F.count_if(F.col("id").isNotNull() & F.col("valid")).alias("clean_rows"),
    )


def row_total(name, df):
    """(name, rows) of one frame."""
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))


def table_sizes(clean, labels):
    """(name, rows) of the clean, label and labeled tables, from one outer join of their ids."""
    sizes = {"clean": "clean_transactions", "labels": "valid_labels", "labeled": "labeled_transactions"}
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("rows")) for n, c in sizes.items()))
    return join_coverage(clean, labels).select(F.inline(rows))


def class_distribution(df, column="class"):
    """(value, count, percentage). The total is a scalar over the counts, which are shared."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", percentage(F.col("count"), whole)).orderBy(column)


def amount_moments(df, column="amount"):
    """One row: min, max, mean and sample deviation."""
    return df.agg(
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("stddev"),
    )


def amount_quartiles(df, column="amount"):
    """One row (q25, q50, q75), exact."""
    found = exact_quantiles(df, column, QUARTILES.values())
    return df.sparkSession.range(1).select(
        *(F.lit(value).cast("double").alias(name) for name, value in zip(QUARTILES, found))
    )


def amount_statistics(df, column="amount"):
    """One row: min, max, mean, sample deviation and the exact quartiles."""
    found = exact_quantiles(df, column, QUARTILES.values())
    return amount_moments(df, column).select(
        "*", *(F.lit(value).cast("double").alias(name) for name, value in zip(QUARTILES, found))
    )


def join_coverage(clean, labels):
    """One row: both table sizes, how many rows met, and the share of transactions labeled.

    A single outer join of the two id columns answers all of it.
    """
    left = clean.select("transaction_id", F.lit(1).alias("has_tx"))
    right = labels.select("transaction_id", F.lit(1).alias("has_label"))
    counted = left.join(right, "transaction_id", "full_outer").agg(
        F.count("has_tx").alias("clean_transactions"),
        F.count("has_label").alias("valid_labels"),
        F.count(F.col("has_tx") + F.col("has_label")).alias("labeled_transactions"),
    )
    clean_rows, met = F.col("clean_transactions"), F.col("labeled_transactions")
    return counted.select(
        "*",
        (clean_rows - met).alias("without_label"),
        percentage(met, clean_rows).alias("coverage_percentage"),
    )


def dropped_rows(raw):
    """One row: raw rows, clean rows, and the difference."""
    return raw_and_clean_rows(raw).withColumn("dropped_rows", F.col("raw_rows") - F.col("clean_rows"))


def overview(raw, labeled):
    """One row of headline numbers: table sizes, fraud rows and fraud share."""
    sizes = raw_and_clean_rows(raw).select(F.col("raw_rows").alias("raw"), F.col("clean_rows").alias("clean"))
    outcomes = labeled.agg(
        F.count(F.lit(1)).alias("labeled"), F.count_if(F.col("class") == 1).alias("fraud")
    )
    both = sizes.unionByName(outcomes, allowMissingColumns=True)
    row = both.agg(*(F.sum(c).alias(c) for c in ("raw", "clean", "labeled", "fraud")))
    return row.withColumn("fraud_rate", percentage(F.col("fraud"), F.col("labeled")))
