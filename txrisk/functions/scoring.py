"""Scores, decisions and bins."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txrisk.settings import NEEDS_REVIEW, NORMAL


def fraud_probability(vector="probability"):
    """Probability of class 1 out of an MLlib probability vector."""
    return vector_to_array(vector)[1]


def decision(score, threshold):
    """1 at or above the threshold, else 0."""
    return (F.col(score) >= F.lit(float(threshold))).cast("int")


def status(prediction="prediction"):
    return F.when(F.col(prediction) == 1, NEEDS_REVIEW).otherwise(NORMAL)


def bin_index(c, bins, lower, upper):
    """Equal-width bin of a value in [lower, upper]; the upper edge joins the last bin."""
    width = (upper - lower) / bins
    return F.least(F.lit(bins - 1), F.floor((F.col(c) - F.lit(lower)) / F.lit(width)).cast("int"))


def ratio(numerator, denominator):
    """Quotient that is 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def percentage(part, whole):
    """100 * part / whole to six decimals; null for an empty whole."""
    return F.round(F.try_divide(100.0 * part, whole), 6)
