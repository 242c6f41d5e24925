"""Reading stream records and writing alert records, both as JSON text."""

from pyspark.sql import functions as F

from txrisk.functions.text import text_or_null
from txrisk.schemas import STREAM_EVENT


def parse_event(value="value"):
    """One pass over the JSON text; every field comes out as text.

    Numbers sent as JSON numbers or as quoted text read alike. A record that is not a JSON
    object leaves all fields null and itself in ``_corrupt_record``.
    """
    return F.from_json(
        F.col(value), STREAM_EVENT, {"columnNameOfCorruptRecord": "_corrupt_record"}
    )


def number(c):
    """A finite double, or null."""
    parsed = F.col(c).try_cast("double")
    return F.when(
        ~F.isnan(parsed) & (F.abs(parsed) < F.lit(float("inf"))), parsed
    )


def text_field(c, default):
    return F.coalesce(F.col(c), F.lit(default))


def present(c):
    return text_or_null(c).isNotNull()


def detected_at(time=None):
    """Processing time, or another, in UTC whatever zone the session runs in."""
    utc = F.to_utc_timestamp(F.current_timestamp() if time is None else time, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def as_json(*columns):
    """The columns as one JSON object; null fields are left out by Spark's writer."""
    return F.to_json(F.struct(*columns))
