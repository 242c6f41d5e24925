"""Interpolated modified Kneser-Ney n-gram model (Chen and Goodman, 1999), counted by Spark.

Tokens are words (A-Z as a-z) and one end per text. A first pass counts the words; the most frequent
get short numbers, by which n-grams travel and are stored in few bytes, the others keep their hashes.
Counting then goes from the longest n-grams down: tasks send the distinct n-grams of their texts;
each reducer adds the counts up, stores its contexts as a sorted hash array with the words that
follow each beside it, and sends on what the next level counts: the n-grams one word shorter with the
number of words seen before them. N-grams that begin with the start of a text, before which nothing
differs, keep their token counts instead.

N-grams are dealt by the hash of their context, so that a context's sums are at hand where it is
stored. A context of very frequent words only, the one kind that could outgrow a hash range, is dealt
by the hash of the whole n-gram; its sums are added up in the next shuffle. Everything is summed in
the map tasks, so no word, pair or text makes a partition much larger than others.

Arrays lie in the shared folder, one file per hash range. Workers map them into memory and look up
sorted batches, so a model larger than a worker's memory can be used.

An n-gram with count c after a context with total t has probability
(c - D(c)) / t + gamma(context) * (probability of the shorter n-gram), where D(1), D(2) and D(3+)
come from the counts of counts of the level; contexts never seen pass the shorter one on, and under
the single words lies an even share for each of the known tokens and one unknown token.

Words and contexts are hashes of 63 and 64 bits. Beside a context a numbered word is exact, any other
has 31 bits of its hash: of a context with f such followers, a share of f / 2 ** 31 of its unseen words
passes for seen.

Null and empty texts are one end token. Repeated texts count each time and score alike. Without any
training text all tokens are unknown and have probability 1. Columns other than id and text are
ignored; an empty table gives no rows.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from txrisk.llm import shared_files, words as W
from txrisk.session import scratch_path

register_pickle_by_value(sys.modules[__name__])

ORDER = 3
# Word names: numbered words are even, hashes odd. The start of a text is number 0, its end a hash.
BEFORE, END = np.uint64(0), np.uint64(0x2E7B)
NUMBERED_WORDS = 1 << 19  # at most; their table is what the driver collects
COUNT_BINS = 1024
CHUNK_BYTES = 1 << 23  # texts whose n-grams are made distinct together
WORDS_HELD = 1 << 21  # distinct words of batches held before they are sent
SCORE_BYTES = 1 << 22  # texts looked up together
RANGES_PER_PARTITION = 4  # hash ranges for each shuffle partition
STRIDE = 16  # every so many contexts, where their followers begin is stored
MOST_OPEN = 8192 if sys.version_info >= (3, 13) else 256  # older versions spend a file number on each
_OPEN = {}


def token_rows(data, offsets):
    """(text, hash) of all tokens, the end of each text included, in order."""
    text, _, _, hashes = W.words(data, offsets)
    texts = len(offsets) - 1
    at = np.searchsorted(text, np.arange(texts), side="right")
    return np.insert(text, at, np.arange(texts)), np.insert(hashes | np.uint64(1), at, END)


def grams(text, names, order):
    """Columns w1..wn of the n-gram that ends at each token; starts are filled up."""
    columns = [names]
    for back in range(1, order):
        column = np.full(len(names), BEFORE, np.uint64)
        if back < len(names):
            same = text[back:] == text[:-back]
            column[back:][same] = names[:-back][same]
        columns.insert(0, column)
    return columns


def gram_hash(columns):
    """One hash for each row of word names."""
    total = W.mix(columns[0] + np.uint64(0x9E3779B97F4A7C15))
    for column in columns[1:]:
        total = W.mix(total * np.uint64(0xD6E8FEB86659FD93) + column)
    return total


def _summed(keys, *values):
    """(positions of distinct keys, sums of each value per key), keys in ascending order."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else order
    return order[first], [np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def pack(counts):
    """Counts as bytes, with those from 255 on kept apart."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), large.astype(np.int64), counts[large].astype(np.int64)


def unpack(small, large, values):
    counts = small.astype(np.int64)
    counts[large] = values
    return counts


def _sealed(arrays):
    head = np.array([len(a) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unsealed(blob, kinds):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, arrays = 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(raw, np.int64, len(kinds))):
        arrays.append(np.frombuffer(raw, kind, size, at))
        at += arrays[-1].nbytes
    return arrays


COUNTS = [np.uint8, np.int64, np.int64]  # what ``pack`` makes
UNNUMBERED = 0xFFFFFF


def _numbers(names):
    return np.where(names & np.uint64(1), UNNUMBERED, names >> np.uint64(1)).astype(np.uint32)


def _gram_blob(columns, counts):
    """N-grams, which should be sorted, as bytes: three for each number, byte by byte, hashes apart."""
    parts = []
    for place, names in enumerate(columns):
        numbers = _numbers(names)
        if not place:
            numbers = np.diff(numbers, prepend=np.uint32(0))
        parts += [np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4)[:, :3].T).ravel(), names[(names & np.uint64(1)) > 0]]
    return _sealed([*parts, *pack(counts)])


def _grams_of(blob, width):
    parts, columns = _unsealed(blob, [np.uint8, np.uint64] * width + COUNTS), []
    for place in range(width):
        planes = np.zeros((len(parts[2 * place]) // 3, 4), np.uint8)
        planes[:, :3] = parts[2 * place].reshape(3, -1).T
        numbers = planes.view("<u4").ravel()
        if not place:
            numbers = np.cumsum(numbers, dtype=np.uint32) & np.uint32(UNNUMBERED)
        names = numbers.astype(np.uint64) << np.uint64(1)
        names[numbers == UNNUMBERED] = parts[2 * place + 1]
        columns.append(names)
    return columns, [unpack(*parts[2 * width:])]


def _hash_blob(hashes, *counts):
    return _sealed([hashes, *(a for c in counts for a in pack(c))])


def _hashes_of(blob, values):
    hashes, *packed = _unsealed(blob, [np.uint64] + COUNTS * values)
    return [hashes], [unpack(*packed[3 * i:3 * i + 3]) for i in range(values)]


def _gathered(blobs, read, width):
    """Columns and counts of all blobs of a range; no columns where there is no blob."""
    found = [read(blob, width) for blob in blobs]
    columns = [np.concatenate(c) for c in zip(*(c for c, _ in found))]
    return columns, [np.concatenate(v) for v in zip(*(v for _, v in found))]


def _range_of(hashes, ranges):
    """The number of the hash range that each hash lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _split(part):
    """(range, first, end) of the runs of ascending range numbers."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    return [(int(part[a]), a, b) for a, b in zip(edges, [*edges[1:], len(part)])]


def _hot(context, most):
    """Whether all words of a context are so frequent that it could outgrow a hash range."""
    return np.logical_and.reduce([((c & np.uint64(1)) == 0) & (c >> np.uint64(1) <= np.uint64(most)) for c in context])


def _dealt_grams(columns, counts, ranges, most):
    """{hash range: blob} of n-grams, dealt by context, or whole where the context is hot."""
    keys = np.where(_hot(columns[:-1], most), gram_hash(columns), gram_hash(columns[:-1]))
    part = _range_of(keys, ranges)
    pairs = _numbers(columns[0]).astype(np.uint64) << np.uint64(24) | _numbers(columns[1]).astype(np.uint64)
    if ranges <= 1 << 16:  # one number of 64 bits sorts much faster than two columns
        order = np.argsort(part.astype(np.uint64) << np.uint64(48) | pairs)
    else:
        order = np.lexsort((pairs, part))
    part, columns, counts = part[order], [c[order] for c in columns], counts[order]
    return {r: _gram_blob([c[a:b] for c in columns], counts[a:b]) for r, a, b in _split(part)}


def _dealt_words(names, hashes, counts, ranges):
    """{hash range: blob} of words with their counts, dealt by hash and sent by number."""
    part = _range_of(hashes, ranges)
    order = np.lexsort((_numbers(names), part))
    part, names, counts = part[order], names[order], counts[order]
    return {r: _gram_blob([names[a:b]], counts[a:b]) for r, a, b in _split(part)}


def _dealt_hashes(hashes, counts, ranges):
    """{hash range: blob} of ascending hashes with their counts."""
    return {
        r: _hash_blob(hashes[a:b], *(c[a:b] for c in counts)) for r, a, b in _split(_range_of(hashes, ranges))
    }


BLOBS = (
    "part INT, grams ARRAY<BINARY>, contexts ARRAY<BINARY>, "
    "figures ARRAY<STRUCT<level: INT, place: INT, figure: BIGINT>>"
)
FIGURES = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int32()), ("figure", pa.int64())]))


def _batch(grams, contexts=None, figures=None):
    """One row for each group of ranges that has blobs, and one, of group -1, for the figures.

    ``grams`` and ``contexts`` are {range: blob} or lists of them. A blob is led by its range.
    ``figures`` is a pair of a level and its figures; those that are zero are left out.
    """
    def grouped(dealt):
        found = {}
        for blobs in dealt if isinstance(dealt, list) else [dealt or {}]:
            for part, blob in blobs.items():
                found.setdefault(part // RANGES_PER_PARTITION, []).append(part.to_bytes(8, "little") + blob)
        return found

    grams, contexts, extra = grouped(grams), grouped(contexts), []
    if figures:
        level, values = figures
        extra = [[{"level": level, "place": int(p), "figure": int(values[p])} for p in np.flatnonzero(values)]]
    parts = sorted(grams.keys() | contexts.keys())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*parts, *[-1] * len(extra)], pa.int32()),
            pa.array([*map(grams.get, parts), *[None] * len(extra)], pa.list_(pa.binary())),
            pa.array([*map(contexts.get, parts), *[None] * len(extra)], pa.list_(pa.binary())),
            pa.array([*[None] * len(parts), *extra], FIGURES),
        ],
        names=["part", "grams", "contexts", "figures"],
    )


def _by_own_range(column):
    """{range: its blobs} of a group."""
    found = {}
    for blobs in column:
        for blob in blobs if blobs.is_valid else ():
            raw = memoryview(blob.as_buffer())
            found.setdefault(int.from_bytes(raw[:8], "little"), []).append(raw[8:])
    return found


def _folded(tables, most):
    """Lists of (text, hash) rows of texts of about ``most`` bytes; numbers of texts go on within a list."""
    held, size, texts = [], 0, 0
    for table in tables:
        for _, data, offsets in W.batches(table.column(0)):
            text, hashes = token_rows(data, offsets)
            held.append((text + texts, hashes))
            size, texts = size + len(data), texts + len(offsets) - 1
            if size >= most:
                yield held
                held, size, texts = [], 0, 0
    if held:
        yield held


def _count_words(ranges):
    def count(tables):
        held, size = [], 0

        def flush():
            hashes, counts = map(np.concatenate, zip(*held))
            kept, (counts,) = _summed(hashes, counts)
            return _batch(_dealt_hashes(hashes[kept], [counts], ranges))

        for rows in _folded(tables, W.BATCH_BYTES):
            held.append(np.unique(np.concatenate([h for _, h in rows]), return_counts=True))
            size += len(held[-1][0])
            if size >= WORDS_HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        W.release()

    return count


def _bins(counts):
    return np.minimum(np.log2(counts) * 16, COUNT_BINS - 1).astype(np.int64)


def _store_words(folder):
    """Stores the words of a hash range with their token counts; reports kinds, tokens and counts by size."""
    def store(group: pa.Table) -> pa.Table:
        figures = np.zeros(2 + COUNT_BINS, np.int64)
        for part, blobs in _by_own_range(group.column("grams")).items():
            (hashes,), (counts,) = _gathered(blobs, _hashes_of, 1)
            kept, (counts,) = _summed(hashes, counts)
            shared_files.save_arrays(f"{folder}/words-1/{part}", [hashes[kept], *pack(counts)])
            figures += [len(kept), counts.sum(), *np.bincount(_bins(counts), minlength=COUNT_BINS)]
        return pa.Table.from_batches([_batch({}, figures=(0, figures))])

    return store


def _frequent(folder, least):
    """The stored words whose counts are of size ``least`` or more."""
    def read(tables):
        for table in tables:
            for part in table.column(0).to_pylist():
                try:
                    hashes, *counts = shared_files.map_arrays(f"{folder}/words-1/{part}")
                except FileNotFoundError:
                    continue
                counts = unpack(*counts)
                kept = np.flatnonzero(_bins(counts) >= least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[kept].view(np.int64)), pa.array(counts[kept])], names=["hash", "tokens"]
                )

    return read


def _names(folder, hashes):
    """Words by their numbers, where they have one."""
    numbered, numbers = _opened(folder, "numbers", 0, 0)[:2]
    if not len(numbered):
        return hashes
    at = np.minimum(np.searchsorted(numbered, hashes), len(numbered) - 1)
    return np.where(numbered[at] == hashes, numbers[at].astype(np.uint64) << np.uint64(1), hashes)


def _names_of_tokens(folder, hashes):
    """The same with each word looked up once."""
    words, back = np.unique(hashes, return_inverse=True)
    return _names(folder, words)[back]


def _hashes(folder, names):
    by_number = _opened(folder, "numbers", 0, 0)[2]
    out = names.copy()
    numbered = np.flatnonzero((names & np.uint64(1)) == 0)
    out[numbered] = by_number[(names[numbered] >> np.uint64(1)).astype(np.int64) - 1]
    return out


def _short(names):
    """A word beside its context: its number, or 31 bits of its hash."""
    return np.where(
        names & np.uint64(1), names >> np.uint64(33) | np.uint64(1 << 31), names >> np.uint64(1)
    ).astype(np.uint32)


def _count_texts(folder, order, ranges, most):
    def count(tables):
        for rows in _folded(tables, CHUNK_BYTES):
            columns = grams(*map(np.concatenate, zip(*((t, _names_of_tokens(folder, h)) for t, h in rows))), order)
            keys = gram_hash(columns)
            kept, (counts,) = _summed(keys, np.ones(len(keys), np.int64))
            yield _batch(_dealt_grams([c[kept] for c in columns], counts, ranges, most))
        W.release()

    return count


def _context_sums(counts, first):
    """(total count, followers seen once, twice, more often) of the contexts that begin at ``first``."""
    each = (counts, counts == 1, counts == 2, counts > 2)
    return [np.add.reduceat(e.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for e in each]


def _begins(*columns):
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def _context_arrays(contexts, last, counts):
    """Arrays of the rows of a level, sorted by context and short word.

    A context with one follower, seen once, is a hash and a word; others have sums and runs of words.
    """
    first = _begins(contexts)
    sums, sizes = _context_sums(counts, first), np.diff(np.append(first, len(contexts)))
    lone = (sizes == 1) & (sums[0] == 1)
    inner = np.repeat(~lone, sizes)
    starts = np.cumsum(sizes[~lone]) - sizes[~lone]
    return [
        contexts[first[lone]], last[first[lone]], contexts[first[~lone]], starts[::STRIDE], last[inner],
        *pack(counts[inner]), *(a for s in sums for a in pack(s[~lone])),
    ]


def _reduce(level, ranges, folder, most):
    """Adds up one hash range of a level, stores its arrays and sends on what the next level needs.

    ``contexts`` hold hot contexts of the level above, n-grams of this level, by hash with four sums.
    """
    def add_grams(part, columns, counts):
        (counts,), context, short = counts, gram_hash(columns[:-1]), _short(columns[-1])
        order = np.lexsort((columns[-1], short, context))
        columns, context, counts = [c[order] for c in columns], context[order], counts[order]
        first = _begins(context, columns[-1])
        counts = np.add.reduceat(counts, first)
        columns, context, short = [c[first] for c in columns], context[first], short[order[first]]
        hot, sums = _hot(columns[:-1], most), {}
        if hot.any():
            whole = gram_hash([c[hot] for c in columns])
            sort = np.argsort(whole)
            shared_files.save_arrays(f"{folder}/hot-{level}/{part}", [whole[sort], *pack(counts[hot][sort])])
            heads = context[hot]
            at = _begins(heads)
            sums = _dealt_hashes(heads[at], _context_sums(counts[hot], at), ranges)
        if not hot.all():
            arrays = _context_arrays(context[~hot], short[~hot], counts[~hot])
            shared_files.save_arrays(f"{folder}/grams-{level}/{part}", arrays)
        tails = columns[1:]
        seen = np.where(tails[0] == BEFORE, counts, 1)
        at, (seen,) = _summed(gram_hash(tails) if level > 2 else tails[0], seen)
        if level > 2:
            shorter = _dealt_grams([c[at] for c in tails], seen, ranges, most)
        else:
            words = tails[0][at]
            shorter = _dealt_words(words, _hashes(folder, words), seen, ranges)
        return counts, 0, shorter, sums

    def add_words(part, columns, counts):
        hashes = _hashes(folder, columns[0])
        at, (counts,) = _summed(hashes, *counts)
        words, *tokens = _opened(folder, "words", 1, part)
        if not np.array_equal(words, hashes[at]):
            raise ValueError(f"range {part}: the words of the n-grams differ from those counted")
        shared_files.save_arrays(f"{folder}/seen-1/{part}", pack(counts))
        return counts, unpack(*tokens).sum(), {}, {}

    def reduce(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() < 0:
            return group  # the figures of longer n-grams pass
        shorter, contexts, figures = [], [], np.zeros(7, np.int64)
        for part, blobs in _by_own_range(group.column("grams")).items():
            add = add_grams if level > 1 else add_words
            counts, tokens, less, sums = add(part, *_gathered(blobs, _grams_of, level))
            shorter.append(less)
            contexts.append(sums)
            figures += [len(counts), counts.sum(), tokens, *((counts == k).sum() for k in (1, 2, 3, 4))]
        for part, blobs in _by_own_range(group.column("contexts")).items():
            (heads,), sums = _gathered(blobs, _hashes_of, 4)
            at, sums = _summed(heads, *sums)
            arrays = [heads[at], *(a for s in sums for a in pack(s))]
            shared_files.save_arrays(f"{folder}/contexts-{level}/{part}", arrays)
        W.release()
        return pa.Table.from_batches([_batch(shorter, contexts, (level, figures))])

    return reduce


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few figures of each level."""

    folder: str
    order: int
    ranges: int
    most: int  # numbers up to this one are words that may make hot contexts
    tokens: int
    words: int
    discounts: tuple  # of level 1, 2 and so on: D(1), D(2), D(3+)
    base: tuple  # of single words: their kinds, the sum of their counts, and how many have 1, 2, more


def _discounts(figures):
    n1, n2, n3, n4 = (int(f) for f in figures[3:7])
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    found = []
    for k, (own, more) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        value = k - (k + 1) * y * more / own if own and more else min(k, 2) * 0.5
        found.append(min(max(value, 0.05), k - 0.05))
    return tuple(found)


def _figures(blobs, size):
    """{level: sums of its figures}; runs the counting."""
    each = blobs.where(F.col("part") == -1).select(F.inline("figures"))
    found = {}
    for row in each.groupBy("level", "place").agg(F.sum("figure").alias("sum")).collect():
        found.setdefault(row["level"], [0] * size)[row["place"]] = row["sum"]
    return found


def _number_words(spark, texts, ranges, partitions, folder):
    """Counts the words and numbers the most frequent; the last number of those that may make hot contexts."""
    blobs = texts.mapInArrow(_count_words(ranges), BLOBS).groupBy("part").applyInArrow(_store_words(folder), BLOBS)
    _, tokens, *sizes = _figures(blobs, 2 + COUNT_BINS).get(0, [0] * (2 + COUNT_BINS))
    above = np.cumsum(sizes[::-1])[::-1]  # words of each size or larger
    least = int(np.searchsorted(-above, -NUMBERED_WORDS))
    parts = spark.range(0, ranges, 1, partitions)
    found = parts.mapInArrow(_frequent(folder, least), "hash BIGINT, tokens BIGINT").toArrow()
    hashes, counts = (found.column(c).to_numpy() for c in ("hash", "tokens"))
    hashes = np.ascontiguousarray(hashes).view(np.uint64)
    rank = np.lexsort((hashes, -counts))
    numbers = np.empty(len(rank), np.uint32)
    numbers[rank] = np.arange(1, len(rank) + 1)
    order = np.argsort(hashes)
    shared_files.save_arrays(f"{folder}/numbers-0/0", [hashes[order], numbers[order], hashes[rank]])
    return int((counts > tokens / (4 * ranges)).sum())


def fit(docs, text_column="text", order=ORDER):
    """Counts words, then n-grams, over all texts in two jobs, whose reducers store the arrays."""
    if order < 2:
        raise ValueError("an n-gram model needs an order of 2 or more")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES_PER_PARTITION * partitions
    folder = scratch_path(spark, "ngrams")
    texts = docs.select(F.col(f"`{text_column}`").alias("text"))
    most = _number_words(spark, texts, ranges, partitions, folder)
    blobs = texts.mapInArrow(_count_texts(folder, order, ranges, most), BLOBS)
    for level in range(order, 0, -1):
        # A few hash ranges make a group; they are added up one after the other.
        blobs = blobs.groupBy("part").applyInArrow(_reduce(level, ranges, folder, most), BLOBS)
    figures = {level: [0] * 7 for level in range(1, order + 1)} | _figures(blobs, 7)
    one = figures[1]
    more = one[0] - one[3] - one[4]
    return Model(
        folder, order, ranges, most, one[2], one[0],
        tuple(_discounts(figures[level]) for level in range(1, order + 1)),
        (one[0], one[1], one[3], one[4], more),
    )


def _opened(folder, name, level, part):
    """The mapped arrays of one hash range, or None where it holds nothing."""
    key = (folder, name, level, part)
    if key not in _OPEN:
        if len(_OPEN) >= MOST_OPEN:
            _OPEN.pop(next(iter(_OPEN)))
        try:
            _OPEN[key] = shared_files.map_arrays(f"{folder}/{name}-{level}/{part}")
        except FileNotFoundError:
            _OPEN[key] = None
    return _OPEN[key]


def _found(small, large, values, at):
    """Counts at some positions of a packed array."""
    counts = small[at].astype(np.int64)
    wide = np.flatnonzero(counts == 255)
    if len(wide):
        counts[wide] = values[np.searchsorted(large, at[wide])]
    return counts


def _places(stored, wanted):
    """(rows of ``wanted`` that are stored, where) in a sorted array."""
    if not len(stored):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
    hit = np.flatnonzero(stored[at] == wanted)
    return hit, at[hit]


def _by_range(model, hashes, names, level):
    """(rows, opened arrays of each name) of every hash range that is stored; rows by hash."""
    order = np.argsort(hashes)
    for part, a, b in _split(_range_of(hashes[order], model.ranges)):
        arrays = [_opened(model.folder, name, level, part) for name in names]
        if arrays[0] is not None:
            yield order[a:b], *arrays


def _look_up(model, name, level, hashes, sums):
    """``sums`` columns for every hash, zeros where it isn't stored."""
    out = np.zeros((sums, len(hashes)), np.int64)
    for rows, arrays in _by_range(model, hashes, [name], level):
        hit, at = _places(arrays[0], hashes[rows])
        for k in range(sums):
            out[k, rows[hit]] = _found(*arrays[1 + 3 * k:4 + 3 * k], at)
    return out


def _word_counts(model, hashes):
    """Counts of left neighbours and of tokens."""
    out = np.zeros((2, len(hashes)), np.int64)
    for rows, words, seen in _by_range(model, hashes, ["words", "seen"], 1):
        hit, at = _places(words[0], hashes[rows])
        out[0, rows[hit]], out[1, rows[hit]] = _found(*seen, at), _found(*words[1:], at)
    return out


def _in_run(words, low, high, wanted):
    """Where each wanted word is, or would be, between two places of a run of ascending words."""
    out, rows = low.copy(), np.arange(len(low))
    while len(rows):
        middle = (low + high) >> 1
        less = (words[np.minimum(middle, len(words) - 1)] < wanted) & (low < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        still = low < high
        if 2 * np.count_nonzero(still) < len(rows):  # most runs are short and done at once
            out[rows] = low
            rows, low, high, wanted = rows[still], low[still], high[still], wanted[still]
    return out


def _followers(model, level, contexts, short):
    """Count of the word after its context, and the context's four sums."""
    out = np.zeros((5, len(contexts)), np.int64)
    for rows, arrays in _by_range(model, contexts, ["grams"], level):
        lone, only, several, starts, words = arrays[:5]
        hit, at = _places(lone, contexts[rows])
        out[0, rows[hit]] = only[at] == short[rows[hit]]
        out[1:3, rows[hit]] = 1
        hit, at = _places(several, contexts[rows])
        hit = rows[hit]
        first = _begins(at)  # several tokens may have one context; places ascend, as the hashes do
        inner, back = at[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        many = inner % STRIDE  # contexts between the stored start and this one
        ends = np.cumsum(many)
        near = np.arange(many.sum()) + np.repeat(inner - ends, many)
        sizes = sum(_found(*arrays[8 + 3 * k:11 + 3 * k], near) for k in (1, 2, 3))
        skipped = np.concatenate([[0], np.cumsum(sizes)])
        low = starts[inner // STRIDE] + skipped[ends] - skipped[ends - many]
        sums = [_found(*arrays[8 + 3 * k:11 + 3 * k], inner) for k in range(4)]
        for k in range(4):
            out[1 + k, hit] = sums[k][back]
        low, end = low[back], (low + sums[1] + sums[2] + sums[3])[back]
        wanted = short[hit]
        low = _in_run(words, low, end, wanted)
        known = np.flatnonzero(low < end)
        known = known[words[low[known]] == wanted[known]]
        out[0, hit[known]] = _found(*arrays[5:8], low[known])
    return out


def _level_counts(model, level, columns):
    """Count of each n-gram, and the four sums of its context."""
    contexts = gram_hash(columns[:-1])
    hot = _hot(columns[:-1], model.most)
    out = np.zeros((5, len(contexts)), np.int64)
    cold = np.flatnonzero(~hot)
    out[:, cold] = _followers(model, level, contexts[cold], _short(columns[-1][cold]))
    hot = np.flatnonzero(hot)
    out[0, hot] = _look_up(model, "hot", level, gram_hash([c[hot] for c in columns]), 1)[0]
    out[1:, hot] = _look_up(model, "contexts", level - 1, contexts[hot], 4)
    return out


def _discounted(counts, discounts):
    return counts - np.array([0.0, *discounts])[np.minimum(counts, 3)]


def _log_probabilities(model, text, hashes):
    """(log10 probability, token count in training) of each token."""
    kinds, total, n1, n2, more = model.base
    d1, d2, d3 = model.discounts[0]
    words, back = np.unique(hashes, return_inverse=True)  # each word is looked up once
    lefts, tokens = _word_counts(model, words)
    names = _names(model.folder, words)[back]
    even = 1.0 / (kinds + 1)
    if total:
        probability = (_discounted(lefts, model.discounts[0]) + (d1 * n1 + d2 * n2 + d3 * more) * even) / total
    else:
        probability = np.full(len(words), even)
    probability, tokens = probability[back], tokens[back]
    for level in range(2, model.order + 1):
        counts, whole, n1, n2, more = _level_counts(model, level, grams(text, names, level))
        d1, d2, d3 = model.discounts[level - 1]
        seen = whole > 0
        mixed = (_discounted(counts, model.discounts[level - 1]) + (d1 * n1 + d2 * n2 + d3 * more) * probability)
        probability = np.where(seen, mixed / np.maximum(whole, 1), probability)
    return np.log10(probability), tokens


SCORES = (
    "id BIGINT, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE, "
    "perplexity DOUBLE"
)


def score(docs, model, id_column="doc_id", text_column="text"):
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    def rate(tables):
        for table in tables:
            held, size, texts = [], 0, 0
            for _, data, offsets in W.batches(table.column(1)):
                text, hashes = token_rows(data, offsets)
                held.append((text + texts, hashes))
                size, texts = size + len(data), texts + len(offsets) - 1
                if size >= SCORE_BYTES:
                    yield rated(held, texts, table.column(0).slice(0, texts))
                    table, held, size, texts = table.slice(texts), [], 0, 0
            if held:
                yield rated(held, texts, table.column(0))
        W.release()

    def rated(held, texts, ids):
        text, hashes = map(np.concatenate, zip(*held))
        logs, counts = _log_probabilities(model, text, hashes)
        first = np.searchsorted(text, np.arange(texts))
        sizes = np.diff(np.append(first, len(text)))
        base = np.log10((counts + 1) / (model.tokens + model.words + 1))
        scores = np.add.reduceat(logs, first)
        return pa.RecordBatch.from_arrays([
            ids, pa.array(sizes), pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)),
            pa.array(np.full(texts, model.tokens)), pa.array(np.add.reduceat(base, first)), pa.array(scores),
            pa.array(10.0 ** (-scores / sizes)),
        ], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(rate, SCORES).withColumnRenamed("id", id_column)
