"""Model inputs read off a timestamp, as doubles."""

from pyspark.sql import functions as F


def hour(c):
    return F.hour(c).cast("double")


def day_of_week(c):
    """Sunday is 1, Saturday is 7."""
    return F.dayofweek(c).cast("double")


def month(c):
    return F.month(c).cast("double")


def year(c):
    return F.year(c).cast("double")


def is_weekend(c):
    return flag(F.dayofweek(c).isin(1, 7))


def flag(condition):
    """1.0 where the condition holds, 0.0 where it does not or is unknown."""
    return F.when(condition, 1.0).otherwise(0.0)
