"""What a checkpoint says about a stream that stopped."""

from txrisk.sources.publish import names_below


def _last(spark, folder):
    numbers = [int(name) for name in names_below(spark, folder) if name.isdigit()]
    return max(numbers, default=None)


def checkpoint_state(spark, checkpoint):
    """(last batch planned, last batch committed); None where there is none yet.

    A planned batch that is not committed runs again, over the same records and under the same number.
    """
    return _last(spark, f"{checkpoint}/offsets"), _last(spark, f"{checkpoint}/commits")


def next_batch(spark, checkpoint):
    """The number of the batch that a restart begins with."""
    planned, committed = checkpoint_state(spark, checkpoint)
    return planned if planned is not None and planned != committed else (-1 if committed is None else committed) + 1
