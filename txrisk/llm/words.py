"""Words and word shingles of whole Arrow batches as 64-bit hashes, with no Python object per word.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return; A-Z count as a-z. Null texts count as empty.
"""

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 1 << 19
SHINGLE_WORDS = 5
_STEP = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2^64
_CACHE = {}


def release():
    """Gives memory that a task no longer needs back to the system, as Spark keeps its workers.

    Freed arrays otherwise stay in the worker's C heap and in Arrow's pool while later stages run.
    """
    _CACHE.pop("powers", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def mix(x):
    """Finishing step that spreads every input bit over the whole 64-bit result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values():
    if "bytes" not in _CACHE:
        values = np.random.default_rng(20240501).integers(1, 2**64 - 1, 256, dtype=np.uint64)
        values[65:91] = values[97:123]
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _CACHE["bytes"] = values, space
    return _CACHE["bytes"]


def _powers(n):
    """(powers, inverse powers) of the step for at least n positions."""
    if "powers" not in _CACHE or len(_CACHE["powers"][0]) < n:
        size = max(n, 2 * BATCH_BYTES)
        up, down = np.full(size, _STEP, np.uint64), np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _CACHE["powers"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _CACHE["powers"]


def batches(column, most_bytes=BATCH_BYTES, most_rows=1024):
    """(first row, data, offsets) for runs of rows of about ``most_bytes``, a longer text alone.

    Rows are taken ``most_rows`` at a time, so that no copy of a whole Arrow batch is made.
    """
    for first in range(0, len(column), most_rows):
        part = column.slice(first, most_rows).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(part):
            end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
            end = min(max(end, row + 1), len(part))
            yield first + row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
            row = end


def words(data, offsets):
    """(text of each word, start, end, hash); words are in order and never cross texts."""
    values, space = _byte_values()
    inside = ~space[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    first[borders] = inside[borders]
    last = np.empty_like(inside)
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    last[-1] = inside[-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):  # by stretches, so that the arrays of a very long text stay small
        base = start[done]
        until = int(np.searchsorted(start, base + BATCH_BYTES))
        stretch = data[base:end[until - 1]]
        up, down = _powers(len(stretch))
        sums = np.zeros(len(stretch) + 1, np.uint64)
        np.cumsum(values[stretch] * up[:len(stretch)], out=sums[1:])
        s, e = start[done:until] - base, end[done:until] - base
        hashes[done:until] = (sums[e] - sums[s]) * down[s]
        done = until
    text = np.searchsorted(offsets, start, side="right") - 1
    return text, start, end, mix(hashes)


def _factors(size):
    return np.random.default_rng(97).integers(1, 2**63, 64, dtype=np.uint64)[:size] * np.uint64(2) + np.uint64(1)


def shingles(text, hashes, size=SHINGLE_WORDS):
    """(text, hash) of every run of ``size`` words; a text with fewer words is one shingle."""
    factors, n = _factors(size), len(hashes)
    full = np.zeros(0, np.int64)
    if n >= size:
        full = np.flatnonzero(text[:n - size + 1] == text[size - 1:])
    total = np.zeros(len(full), np.uint64)
    for j in range(size):
        total += hashes[full + j] * factors[j]
    numbers, firsts, counts = np.unique(text, return_index=True, return_counts=True)
    of_text, found = [text[full]], [mix(total)]
    for length in range(1, size):
        at = firsts[counts == length]
        short = np.full(len(at), length, np.uint64)
        for j in range(length):
            short += hashes[at + j] * factors[j]
        of_text.append(numbers[counts == length])
        found.append(mix(short))
    of_text, found = np.concatenate(of_text), np.concatenate(found)
    order = np.argsort(of_text, kind="stable")
    return of_text[order], found[order]
