"""From raw rows to clean transactions, clean labels and the labeled table."""

from pyspark.sql import functions as F

from txrisk.functions import text
from txrisk.operators.keys import keep_one_per_key
from txrisk.schemas import LABELED_COLUMNS
from txrisk.settings import UNKNOWN


def parse_transactions(raw):
    """Rename and parse all twelve raw columns; no row is dropped here."""
    return raw.select(
        F.col("id").alias("transaction_id"),
        text.timestamp("date").alias("transaction_time"),
        "client_id",
        "card_id",
        text.money("amount").alias("amount"),
        text.text_or("use_chip", UNKNOWN).alias("use_chip"),
        "merchant_id",
        text.text_or_null("merchant_city").alias("merchant_city"),
        text.text_or_null("merchant_state").alias("merchant_state"),
        text.zip_code("zip").alias("zip"),
        "mcc",
        text.text_or_null("errors").alias("errors"),
    )


def usable_amount(c="amount"):
    """A number that is not negative. Null and NaN both stand in as -1, so it is read once."""
    number = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nanvl(number, F.lit(-1.0)), F.lit(-1.0)) >= 0


def valid_transaction():
    """Id and time present, amount a number that is not negative."""
    return (
        F.col("transaction_id").isNotNull()
        & F.col("transaction_time").isNotNull()
        & usable_amount()
    )


def with_year(transactions):
    return transactions.withColumn("transaction_year", F.year("transaction_time"))


def clean_transactions(raw):
    """Parsed, valid, one row per id, with the year to partition by.

    The result is hash-partitioned by ``transaction_id``, so a join on it needs no new shuffle.
    """
    parsed = parse_transactions(raw).where(F.col("transaction_id").isNotNull())
    return with_year(keep_one_per_key(parsed, "transaction_id", among=valid_transaction()))


def parse_labels(raw_labels):
    """Id and class of the label rows that have both."""
    return raw_labels.select("transaction_id", text.label_class("label").alias("class")).where(
        F.col("transaction_id").isNotNull() & F.col("class").isNotNull()
    )


def label_conflicts(raw_labels):
    """Ids labeled both ways."""
    per_id = parse_labels(raw_labels).groupBy("transaction_id").agg(
        F.min("class").alias("low"), F.max("class").alias("high")
    )
    return per_id.where("low < high").select("transaction_id", F.lit(2).alias("class_count"))


def require_consistent_labels(raw_labels):
    conflicting = label_conflicts(raw_labels).count()
    if conflicting:
        raise ValueError(f"{conflicting} transaction ids carry conflicting fraud labels")
    return raw_labels


def clean_labels(raw_labels):
    """One class per id. Check :func:`require_consistent_labels` first."""
    return parse_labels(raw_labels).groupBy("transaction_id").agg(F.min("class").alias("class"))


def label_transactions(clean, labels):
    """Inner join on the id, in the stored column order. Both sides are unique by id."""
    return clean.join(labels, "transaction_id", "inner").select(*LABELED_COLUMNS)


def unlabeled_transactions(clean, labels):
    return clean.join(labels, "transaction_id", "left_anti")


def parse_new_transactions(raw):
    return raw.withColumn("transaction_time", text.timestamp("transaction_time"))


def scorable_transaction():
    """As for training, and the MCC has to be there too."""
    return valid_transaction() & F.col("mcc").isNotNull()


def rejected_new_transactions(parsed):
    """Rows a model must not score."""
    return parsed.where(~scorable_transaction())
