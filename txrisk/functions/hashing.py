"""Repeatable pseudo-random places of a row, from its id and a seed.

A row falls into one of a million buckets, and has a finer place of 40 bits inside its bucket. A
share in whole millionths takes whole buckets; any other share, however small, cuts a bucket finely.
"""

from pyspark.sql import functions as F

from txrisk.settings import HASH_BUCKETS

FINE = 1 << 40
_FINE_SEED = 1_000_003  # set apart from every seed that picks buckets


def _seed(seed):
    return F.lit(seed) if isinstance(seed, int) else seed


def xxhash_bucket(key, seed, buckets=HASH_BUCKETS):
    """The default: cheap, and independent of partitioning and row order."""
    return F.pmod(F.xxhash64(F.col(key), _seed(seed)), F.lit(buckets))


def xxhash_place(key, seed):
    """Bucket and place inside it as one whole number below ``HASH_BUCKETS * FINE``."""
    inside = F.pmod(F.xxhash64(F.col(key), _seed(seed), F.lit(_FINE_SEED)), F.lit(FINE))
    return xxhash_bucket(key, seed) * F.lit(FINE) + inside


def _md5(key, seed):
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), _seed(seed).cast("string")))


def md5_bucket(key, seed, buckets=HASH_BUCKETS):
    """Same idea on md5, which any SQL engine can repeat."""
    return F.conv(F.substring(_md5(key, seed), 1, 8), 16, 10).cast("bigint") % buckets


def md5_place(key, seed):
    inside = F.conv(F.substring(_md5(key, seed), 9, 10), 16, 10).cast("bigint")
    return md5_bucket(key, seed) * F.lit(FINE) + inside


def share_bound(share):
    """The place up to which ``share`` of all places lie."""
    return F.floor(F.lit(share) * F.lit(float(HASH_BUCKETS * FINE))).cast("bigint")


def hash_share(key, seed, share, place=xxhash_place):
    """True for ``share`` of all keys: a number or a column between 0 and 1."""
    return place(key, seed) < share_bound(share)
