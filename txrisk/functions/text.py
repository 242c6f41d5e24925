"""Cleaning rules for single text cells."""

from pyspark.sql import functions as F

from txrisk.settings import NO_STATE, TIME_FORMAT, UNKNOWN


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def trimmed(c):
    return F.trim(_col(c).cast("string"))


def is_missing(c):
    """Null, or nothing but spaces."""
    return _col(c).isNull() | (trimmed(c) == "")


def text_or_null(c):
    return F.nullif(trimmed(c), F.lit(""))


def text_or(c, default):
    return F.coalesce(text_or_null(c), F.lit(default))


def money(c):
    """``$1,234.50`` to 1234.5; text that is not a number gives null."""
    return F.translate(F.trim(_col(c)), "$,", "").try_cast("double")


def timestamp(c):
    """A ``yyyy-MM-dd HH:mm:ss`` cell; anything else gives null."""
    return F.try_to_timestamp(F.trim(_col(c)), F.lit(TIME_FORMAT))


def zip_code(c):
    """ZIPs read as floats lose their ``.0`` tail."""
    return F.regexp_replace(text_or_null(c), r"\.0$", "")


def label_class(c):
    """Yes is 1, No is 0, any other word is null."""
    word = F.upper(F.trim(_col(c)))
    return F.when(word == "YES", 1).when(word == "NO", 0)


def mcc_category(c="mcc"):
    return F.coalesce(_col(c).cast("string"), F.lit(UNKNOWN))


def state_category(c="merchant_state"):
    return text_or(c, NO_STATE)


def iso_timestamp(c):
    """ISO date-time as written, keeping its own wall clock.

    A ``Z`` or numeric offset is dropped instead of converted, so the hour is the one the
    sender wrote. Text that is not a full ISO date gives null.
    """
    text = F.trim(_col(c))
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"
    wall_clock = F.regexp_replace(text, r"([Zz]|(?<=:\d{2}(\.\d{1,6})?)[+-]\d{2}:?\d{2})$", "")
    return F.when(text.rlike(shape), F.try_to_timestamp(wall_clock))
