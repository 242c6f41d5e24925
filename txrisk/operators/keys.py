"""Keeping, counting and checking rows per key."""

from pyspark.sql import functions as F


def keep_one_per_key(df, *keys, among=None):
    """One row per key: the smallest by the other columns, read left to right.

    ``among`` limits which rows may stand for their key; keys without such a row are left out.
    Given here rather than as a filter before, it reads columns already computed, where a filter
    would be pushed down and parse the raw cells a second time.

    Written as a ``min`` over a struct, so copies of a key are folded before the shuffle and
    a key holding a large share of the rows costs one row per map task. The choice does not
    depend on partitioning, unlike ``dropDuplicates``.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    if among is None:
        kept = df.groupBy(*keys).agg(F.min(row).alias("kept"))
    else:
        # The flag of its own lets Spark drop the row where only keys are asked for.
        kept = df.groupBy(*keys).agg(
            F.bool_or(among).alias("found"), F.min(F.when(among, row)).alias("kept")
        ).where("found")
    return kept.select(*(F.col(c) if c in keys else F.col(f"kept.{c}") for c in df.columns))


def surplus_duplicates(df, *keys):
    """One row: how many rows repeat a key that was already there. Keys with a null do not count."""
    copies = df.dropna(subset=list(keys)).groupBy(*keys).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def duplicated_keys(df, *keys):
    """One row: how many distinct keys (nulls included) occur more than once."""
    copies = df.groupBy(*keys).count()
    return copies.agg(F.count_if(F.col("count") > 1).alias("duplicate_ids"))


def missing_columns(df, required):
    return sorted(set(required).difference(df.columns))


def require_columns(df, required):
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df
