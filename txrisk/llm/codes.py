"""Vector compression by product codes, in integers only.

A vector's components become integers, and the vector is cut into equal consecutive parts; each part
position has a codebook. Codebooks start as parts of the vectors with the smallest ids and are
moved by rounds of assigning every part to its nearest entry and replacing entries by the floored
mean of their parts.

Nearest entries are found by the Walsh-Hadamard transform of parts and entries, padded with zeros to
a power of two: the transformed squared distance is that power times the squared distance. Squared
differences are added in sequency order, where most of the distance comes first; an entry is dropped
as soon as its sum exceeds the full distance of the entry that looked nearest at first. All sums are
integers, so nothing is lost to rounding and ties are ties.

Assignments run in tasks over stored integer rows; each task sends one sum per entry and component.
The driver holds the codebooks, whose size is entries times vector width, and nothing else.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as
ending in zeros; a width that the parts don't divide is filled up with zeros. Null ids come after
all others and repeated ids are ordered by their vectors when the starting entries are chosen; every
row counts, also repeated ones. With fewer rows than entries there are as many entries as rows. An
empty table gives no rows. Components beyond what 64-bit sums can hold are handled in Python's own
integers; a total beyond 64 bits is an error. Other columns are ignored.
"""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from txrisk.llm import vectors as V
from txrisk.session import written

register_pickle_by_value(sys.modules[__name__])

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
ROWS_AT_ONCE = 4096


def sequency(size):
    """The order of the transform's rows by their number of sign changes; ``size`` is a power of two."""
    signs = np.ones((1, 1), np.int64)
    while len(signs) < size:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def transformed(rows):
    """The Walsh-Hadamard transform of each row, padded with zeros, in sequency order."""
    size = 1
    while size < rows.shape[1]:
        size *= 2
    out = np.zeros((len(rows), size), rows.dtype)
    out[:, :rows.shape[1]] = rows
    half = 1
    while half < size:
        pairs = out.reshape(len(rows), size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return out.reshape(len(rows), size)[:, sequency(size)]


def nearest(parts, entries):
    """(entry, squared distance) nearest to each part, ties to the lower entry; both transformed."""
    size = parts.shape[1]
    head = min(size, 2)
    sums = sum((parts[:, None, c] - entries[None, :, c]) ** 2 for c in range(head))
    guess = sums.argmin(axis=1)
    most = ((parts - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= most[:, None])
    total = sums[row, entry]
    for c in range(head, size):
        total = total + (parts[row, c] - entries[entry, c]) ** 2
        stays = total <= most[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    best = np.full(len(parts), -1, np.int64)
    least = most.copy()
    for place in range(len(entries) - 1, -1, -1):  # the lowest entry with the least sum has the last word
        own = entry == place
        rows, sums_of = row[own], total[own]
        wins = sums_of <= least[rows]
        best[rows[wins]], least[rows[wins]] = place, sums_of[wins]
    return best, least // size


def _fits(width, largest):
    """Do all sums of transformed squared differences fit 64 bits?"""
    size = 1
    while size < width:
        size *= 2
    return size * max(width, 1) * (2 * largest) ** 2 < 2**63


def _matrix(column, width, kind):
    whole = V.matrix(column, np.int64, width)
    return whole if kind == "int" else whole.astype(object)


class Codebooks:
    """``entries[part][entry]`` as lists of integers."""

    def __init__(self, entries, kind):
        self.entries, self.kind = entries, kind
        self.parts, self.width = len(entries), len(entries[0][0])

    def arrays(self):
        kind = np.int64 if self.kind == "int" else object
        return [np.array(own, kind).reshape(len(own), self.width) for own in self.entries]

    def sha256(self):
        flat = (str(x) for own in self.entries for entry in own for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def assigned(self, column):
        """(first row, parts of rows, codes, distances) for runs of rows of an Arrow list column."""
        entries = [transformed(own) for own in self.arrays()]
        for first in range(0, len(column), ROWS_AT_ONCE):
            rows = _matrix(column.slice(first, ROWS_AT_ONCE), self.parts * self.width, self.kind)
            cut = rows.reshape(len(rows), self.parts, self.width)
            pairs = [nearest(transformed(cut[:, p]), entries[p]) for p in range(self.parts)]
            yield first, cut, np.stack([e for e, _ in pairs], 1), np.stack([d for _, d in pairs], 1)


def integers(rows, id_column="vec_id", vector_column="embedding", label_column="label", scale=SCALE):
    """Stored (id, label, v): the usable vectors with components floor(scale * x)."""
    vector = F.col(f"`{vector_column}`")
    kept = rows.where(V.usable(vector)).select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").alias("label"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("v"),
    )
    return written(kept, "code-integers")


def start(table, parts=PARTS, entries=ENTRIES):
    """The first codebooks, or None for an empty table."""
    width, largest = table.agg(
        F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    ).head()
    if width is None:
        return None
    own = -(-width // parts)
    first = table.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    padded = [[*r.v, *[0] * (own * parts - len(r.v))] for r in first]
    books = [[row[p * own:(p + 1) * own] for row in padded] for p in range(parts)]
    return Codebooks(books, "int" if _fits(own, largest or 0) else "object")


def moved(table, books):
    """The codebooks after one round over all rows."""
    def sums(tables):
        entries = len(books.entries[0])
        kind = np.int64 if books.kind == "int" else object
        total = np.zeros((books.parts, entries, books.width), kind)
        count = np.zeros((books.parts, entries), np.int64)
        for table in tables:
            for _, cut, codes, _ in books.assigned(table.column(0)):
                for p in range(books.parts):
                    np.add.at(total[p], codes[:, p], cut[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()),
            pa.array([[str(x) for x in total[p, e]] for p, e in zip(part, entry)], pa.list_(pa.string())),
        ], names=["part", "entry", "n", "sums"])

    found = table.select("v").mapInArrow(sums, "part INT, entry INT, n BIGINT, sums ARRAY<STRING>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.width)]
    folded = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide)
    entries = [list(own) for own in books.entries]
    for r in folded.collect():  # one row per used entry
        entries[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(books.width)]
    return Codebooks(entries, books.kind)


def encoded(table, books):
    """(id, label, code, error) of every row."""
    def encode(tables):
        for table in tables:
            codes, errors = [], []
            for _, _, found, distances in books.assigned(table.column(2)):
                codes += [bytes(row).hex() for row in found.astype(np.uint8)]
                errors += distances.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([
                table.column(0), table.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())
            ], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    return table.mapInArrow(
        encode, f"id {kinds['id']}, label {kinds['label']}, code STRING, error BIGINT"
    )


def compress(rows, id_column="vec_id", vector_column="embedding", label_column="label",
             scale=SCALE, parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """((id, label, code, error) of every usable row, codebooks); codebooks are None without rows."""
    if entries > 256:
        raise ValueError("an entry's number has two hex digits, so a codebook has 256 entries at most")
    table = integers(rows, id_column, vector_column, label_column, scale)
    books = start(table, parts, entries)
    if books is None:
        return table.selectExpr("id", "label", "CAST(NULL AS STRING) AS code", "CAST(NULL AS BIGINT) AS error"), None
    for _ in range(rounds):
        books = moved(table, books)
    return encoded(table, books), books


def with_label_errors(coded):
    """Adds ``label_error``: the errors of all rows with the same label, null labels together.

    Sums fold in the map tasks; rows only meet their label's sum, by a join that Spark may split.
    """
    coded = written(coded, "code-rows")
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(total), "code-label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
