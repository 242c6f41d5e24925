"""Batch sinks. All go through Spark's committed writers, so a reader never sees half a table."""

import json

from txrisk.operators.audits import require_rows
from txrisk.sources.publish import publish


def write_table(df, path, *partition_columns, rebalance=False):
    """Overwrites a Parquet table.

    ``rebalance`` asks AQE to even out the files per partition value, splitting values that hold
    many rows. It costs a shuffle and pays off when many small tasks meet many values.
    """
    if rebalance:
        df = df.hint("rebalance", *partition_columns)
    writer = df.write.mode("overwrite")
    if partition_columns:
        writer = writer.partitionBy(*partition_columns)
    writer.parquet(path)
    return path


def write_result_table(df, path, columns=None, most_rows=100_000):
    """A small result table as one headered CSV file; columns not asked for are left out.

    A table of more than ``most_rows`` is no result table and is refused: see :func:`write_export`.
    """
    chosen = df.select(*columns) if columns else df
    if chosen.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"{path}: more than {most_rows} rows do not go into one file")
    chosen.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def write_export(df, path):
    """A large table as headered CSV parts, in order and in parallel."""
    df.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    return path


def write_report(spark, report, path):
    """A nested report as one JSON document; an earlier one is replaced once it is read back whole."""
    text = json.dumps(report, indent=2, ensure_ascii=False)
    document = spark.createDataFrame([(text,)], "value STRING").coalesce(1)

    def check(name):
        if [row[0].strip() for row in spark.read.text(name, wholetext=True).take(2)] != [text]:
            raise RuntimeError(f"the report for {path} was not written whole")

    publish(spark, path, document.write.text, check)
    return path


def reconcile(spark, path, expected, what):
    """Reads a written table back and raises unless it holds the expected rows."""
    table = spark.read.parquet(path)
    require_rows(table.count(), expected, what)
    return table
