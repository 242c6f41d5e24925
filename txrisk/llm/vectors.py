"""Vector columns: which rows are usable, and Arrow lists as numpy matrices."""

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])


def usable(vector):
    """True for vectors that are there and hold only finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def matrix(column, dtype, width=None):
    """An Arrow list column as rows of one matrix; short rows end in zeros, long ones are cut."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return values[offsets[0]:offsets[-1]].astype(dtype).reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype)
    for row, (start, length) in enumerate(zip(offsets, lengths)):
        length = min(length, width)
        out[row, :length] = values[start:start + length]
    return out


def best_per_row(rows, scores, ids, k):
    """Positions of each row's ``k`` highest scores, ties to the smaller id, by row and rank."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - first < k]
