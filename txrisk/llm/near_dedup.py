"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

A text is its set of five-word shingles, each with weight 1 + ln(count). A shingle is a Poisson
process whose rate is its weight; every arrival falls into a random register, and a register keeps
the shingle that arrived first (ProbMinHash, Ertl 2020). Two texts agree in a register with the
probability Jaccard similarity of their weighted sets. Arrivals are drawn until no shingle can still
beat the slowest register. Runs of ``BAND_ROWS`` registers are buckets. As links are decided by the
plain sets, a text that repeats shingles goes into the buckets of a second signature too, with all
weights 1, where the probability is the similarity of the sets: at 0.8 a pair shares none of
``BANDS`` buckets with probability 5e-5, however often either text repeats what it holds.

Candidates are verified by the exact Jaccard similarity of their shingle sets. To verify a bucket
without all of its pairs, its members are compared with its most central member, the one that meets
most others over all its buckets, and components are formed; members that stay outside their
centre's component are compared with a centre of their own in a second round. What is then still
open is decided by edits. The edits of a text are the shingles it adds to its centre and those it
lacks. A text y below the similarity to the centre c differs by more than (|y| + |c|) / 9 shingles,
so another text x can only be similar to y if the two share more than
(|edits of x| + (|c| - |x|) / 9) / 2 edits. With the edits of all texts in one order, rare ones first,
the first shared edit must leave as many behind it in both texts, so texts are looked up by their
rarest edits only (prefix and positional filters of exact set joins). Thus no link between texts of
a bucket is lost, and no bucket gives all its pairs.

Texts with the same words (A-Z as a-z) are copies; one of them stands for all. Null texts and texts
without words belong to no one. Texts under five words are one shingle. Rows that share an id are
one document, linked by any of its texts; rows with a null id are left out. An empty table gives no
rows. Other columns are ignored.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Window, functions as F

from txrisk.llm import words as W
from txrisk.llm.components import components
from txrisk.session import written

register_pickle_by_value(sys.modules[__name__])

REGISTERS, BAND_ROWS, BANDS = 128, 5, 25
SIMILARITY = 0.8  # the bounds on edits in _open_pairs hold for this value: (1 - 0.8) / (1 + 0.8) = 1 / 9
FILTER_BITS = 1 << 25  # 4 MB, the most that maybe_among broadcasts
ARRIVALS = 1 << 18  # drawn at once
SKETCH = "id BIGINT, print1 BIGINT, print2 BIGINT, bands ARRAY<BIGINT>"
SETS = "id BIGINT, size INT, shingles BINARY"


def fingerprints(texts, text, hashes):
    """Two 64-bit prints of each text's word sequence, and whether it has words."""
    up, down = W._powers(len(hashes) + 1)
    first = np.searchsorted(text, np.arange(texts))
    last = np.searchsorted(text, np.arange(texts), side="right")
    prints = []
    for salt in (0x51, 0xA7):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(W.mix(hashes + np.uint64(salt)) * up[:len(hashes)], out=sums[1:])
        total = (sums[last] - sums[first]) * down[np.minimum(first, len(hashes))]
        prints.append(W.mix(total + (last - first).astype(np.uint64)))
    return prints[0], prints[1], last > first


def weighted_shingles(text, hashes):
    """(text, shingle, weight) with each shingle of a text once."""
    text, found = W.shingles(text, hashes)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(found)))
    return text[first], found[first], 1 + np.log(counts)


def prob_min_hash(texts, text, items, weights, registers=REGISTERS):
    """The registers of every text, as the item that arrived first in each."""
    times = np.full(texts * registers, np.inf)
    held = np.zeros(texts * registers, np.uint64)
    clock = np.zeros(len(items))
    active, step = np.arange(len(items)), 0
    while len(active):
        draws = int(np.clip(ARRIVALS // len(active), 1, 64)) if step else 1
        numbers = (np.arange(step + 1, step + draws + 1, dtype=np.uint64) * np.uint64(W._STEP))[None, :]
        bits = W.mix(items[active][:, None] + numbers)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active][:, None]
        at = clock[active][:, None] + np.cumsum(gaps, axis=1)
        slot = text[active][:, None] * registers + (bits & np.uint64(registers - 1)).astype(np.int64)
        np.minimum.at(times, slot.ravel(), at.ravel())
        won = times[slot] == at
        held[slot[won]] = np.broadcast_to(items[active][:, None], slot.shape)[won]
        clock[active] = at[:, -1]
        slowest = times.reshape(texts, registers).max(axis=1)
        active, step = active[clock[active] < slowest[text[active]]], step + draws
    return held.reshape(texts, registers)


def band_keys(signatures, rows=BAND_ROWS, bands=BANDS):
    """One 64-bit key per band; equal registers in a band give equal keys, bands never meet."""
    parts = signatures[:, :rows * bands].reshape(len(signatures), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(W._STEP), parts.shape[:2]).copy()
    for j in range(rows):
        total = W.mix(total + parts[:, :, j])
    return total


def bucket_keys(texts, of, items, weights):
    """(text, key): the distinct keys of each text by its weighted shingles and by their plain set.

    Both signatures have the same buckets. Texts that repeat no shingle have one signature.
    """
    weighted = band_keys(prob_min_hash(texts, of, items, weights))
    again = np.unique(of[weights > 1])
    own = np.isin(of, again)
    plain = band_keys(prob_min_hash(len(again), np.searchsorted(again, of[own]), items[own], np.ones(own.sum())))
    text = np.repeat(np.concatenate([np.arange(texts), again]), BANDS)
    keys = np.concatenate([weighted, plain]).ravel()
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return text[new], keys[new]


def _sketch(tables):
    for table in tables:
        ids = table.column(0)
        for row, data, offsets in W.batches(table.column(1)):
            texts = len(offsets) - 1
            text, _, _, hashes = W.words(data, offsets)
            print1, print2, worded = fingerprints(texts, text, hashes)
            of, items, weights = weighted_shingles(text, hashes)
            owner, keys = bucket_keys(texts, of, items, weights)
            keep = np.flatnonzero(worded)
            kept = worded[owner]
            edges = np.searchsorted(owner[kept], np.append(keep, texts)).astype(np.int32)
            lists = pa.ListArray.from_arrays(edges, keys[kept].astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                ids.slice(row, texts).take(pa.array(keep)), pa.array(print1[keep].astype(np.int64)),
                pa.array(print2[keep].astype(np.int64)), lists,
            ], names=["id", "print1", "print2", "bands"])
    W.release()


def _shingle_sets(tables):
    for table in tables:
        ids = table.column(0)
        for row, data, offsets in W.batches(table.column(1)):
            texts = len(offsets) - 1
            text, _, _, hashes = W.words(data, offsets)
            of, items, _ = weighted_shingles(text, hashes)
            edges = np.searchsorted(of, np.arange(texts + 1))
            yield pa.RecordBatch.from_arrays([
                ids.slice(row, texts), pa.array(np.diff(edges).astype(np.int32)),
                pa.array([items[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
            ], names=["id", "size", "shingles"])
    W.release()


def _compared(tables):
    for table in tables:
        rows = table.num_rows
        found, edits = np.empty(rows), []
        left, right, many = table.column(2), table.column(3), table.column(4).to_pylist()
        for row, (x, y) in enumerate(zip(left, right)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            found[row] = shared / max(1, len(both) - shared)
            if many[row]:
                added, lacking = np.setdiff1d(y, x, True), np.setdiff1d(x, y, True)
                edits.append(np.concatenate([added, ~lacking]).astype(np.int64))
            else:
                edits.append(None)
        yield pa.RecordBatch.from_arrays([
            table.column(0), table.column(1), pa.array(found), pa.array([e if e is None else e.tolist() for e in edits], pa.list_(pa.int64())),
        ], names=["a", "b", "similarity", "edits"])


def with_maybe(docs, ids, id_column="id", bits=FILTER_BITS):
    """``docs`` with ``__maybe``: false where the id is surely none of ``ids`` (id), by one bitmap.

    The broadcast bitmap has a fixed size however many ids there are; with very many of them more
    rows are true. Null ids are false.
    """
    def place_of(column):
        return F.when(column.isNotNull(), F.pmod(F.xxhash64(column.cast("bigint")), F.lit(bits)) + 1)

    place = place_of(F.col(f"`{id_column}`"))
    bitmap = ids.select(place_of(F.col("id")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits")
    )
    placed = docs.withColumns({"__bucket": F.bitmap_bucket_number(place), "__at": F.bitmap_bit_position(place)})
    byte = F.substring("__bits", (F.col("__at") / 8).cast("int") + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    hit = number.bitwiseAND(F.pow(F.lit(2), F.col("__at") % 8).cast("int")) > 0
    marked = placed.join(F.broadcast(bitmap), "__bucket", "left")
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(hit, F.lit(False)).alias("__maybe"))


def maybe_among(docs, ids, bits=FILTER_BITS):
    """The rows whose id is one of ``ids``, and few others."""
    return with_maybe(docs, ids, bits=bits).where("__maybe").drop("__maybe")


def shingle_sets(docs, ids):
    """(id, size, shingles) of the documents with these ids, stored."""
    # An inner join, as the optimizer would pull a semi join below the filter.
    wanted = maybe_among(docs, ids).join(ids, "id")
    return written(wanted.mapInArrow(_shingle_sets, SETS), "shingle-sets")


def verified(sets, pairs):
    """(a, b, similarity, edits, size_a, size_b) of candidate pairs (a, b, many); edits where many."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", "many")
    compared = joined.mapInArrow(_compared, "a BIGINT, b BIGINT, similarity DOUBLE, edits ARRAY<BIGINT>")
    return written(compared, "compared")


def linked(compared):
    return compared.where(F.col("similarity") >= SIMILARITY).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _with_centre(cells):
    """Cells (key, id) with the most central id of their key, and the number of ids."""
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = written(cells.join(sizes, "key"), "buckets")
    central = shared.groupBy("id").agg(F.sum("n").alias("score"))
    centres = shared.join(central, "id").groupBy("key").agg(
        F.max(F.struct("score", F.col("id"))).getField("id").alias("centre")
    )
    return written(shared.join(centres, "key"), "starred-buckets")


def _spokes(starred):
    pairs = starred.where(F.col("id") != F.col("centre")).groupBy(F.col("centre").alias("a"), F.col("id").alias("b"))
    return pairs.agg((F.max("n") > 2).alias("many"))


def _star_edges(roots):
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def _with_roots(frame, roots, column, name):
    found = frame.join(roots.select(F.col("node").alias(column), F.col("root").alias("__root")), column, "left")
    return found.withColumn(name, F.coalesce("__root", column)).drop("__root")


def _open_pairs(compared, sizes, roots):
    """Pairs of different components under one centre that share enough edits to be similar."""
    size_a, size_b = (sizes.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}")) for c in "ab")
    spokes = compared.where(F.col("edits").isNotNull()).join(size_a, "a").join(size_b, "b")
    spokes = _with_roots(_with_roots(spokes, roots, "a", "root_a"), roots, "b", "root_b")
    spokes = written(spokes.select("a", "b", "edits", "size_a", "size_b", "root_a", "root_b"), "spokes")
    centres = spokes.where(F.col("root_a") != F.col("root_b")).select("a").distinct()
    spread = spokes.join(centres, "a", "left_semi").withColumn("length", F.size("edits"))
    spread = spread.select("*", F.explode("edits").alias("edit")).drop("edits")
    # One order of edits for all texts of a centre, rare ones first; each text's places in it.
    often = spread.groupBy("a", "edit").agg(F.count(F.lit(1)).alias("often"))
    places = Window.partitionBy("a", "b").orderBy("often", "edit")
    placed = spread.join(often, ["a", "edit"]).withColumn("left", F.col("length") - F.row_number().over(places) + 1)
    placed = written(placed.select("a", "b", "edit", "left", "length", "size_a", "size_b", "root_a", "root_b"), "edits")
    # ``left`` counts the text's edits from this one on, and so bounds what a pair that first meets
    # here can share.
    needed = (F.col("length") + (F.col("size_a") - F.col("size_b")) / F.lit(9.0)) / 2 - F.lit(1e-6)
    # An edit that only one component has makes no pair; families of near copies have many of them.
    several = placed.groupBy("a", "edit").agg(F.min("root_b").alias("least"), F.max("root_b").alias("most"))
    several = several.where(F.col("least") != F.col("most")).select("a", "edit")
    placed = written(placed.join(several, ["a", "edit"], "left_semi"), "shared-edits")
    looked = placed.where(F.col("left") >= needed).select(
        "a", "edit", F.col("b").alias("x"), F.col("root_b").alias("root_x"), F.col("size_b").alias("size_x"),
        F.col("left").alias("left_x"), F.col("length").alias("length_x"),
    )
    held = placed.where(F.col("root_a") != F.col("root_b")).select(
        "a", "edit", F.col("b").alias("y"), F.col("root_b").alias("root_y"), F.col("size_b").alias("size_y"),
        F.col("left").alias("left_y"), F.col("length").alias("length_y"),
    )
    near = F.least("size_x", "size_y") >= F.lit(SIMILARITY) * F.greatest("size_x", "size_y")
    shared = (F.col("length_x") + F.col("length_y") - (F.col("size_x") + F.col("size_y")) / F.lit(9.0)) / 2 - F.lit(1e-6)
    enough = F.least("left_x", "left_y") >= shared
    met = looked.join(held, ["a", "edit"]).where((F.col("root_x") != F.col("root_y")) & near & enough)
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return written(pairs.withColumn("many", F.lit(False)), "open-pairs")


def near_duplicates(docs, id_column="doc_id", text_column="text"):
    """(id, class_id, verified_links): the smallest id of each document's class, and its links.

    ``verified_links`` counts those links to other texts that had to be verified to find the classes.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").alias("text"))
    rows = rows.where(F.col("id").isNotNull())
    sketches = written(rows.mapInArrow(_sketch, SKETCH), "sketches")
    groups = sketches.groupBy("print1", "print2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    groups = written(groups, "texts")

    starred = _with_centre(groups.select(F.col("rep").alias("id"), F.explode("bands").alias("key")).distinct())
    sets = shingle_sets(rows, starred.select("id").distinct())
    first = verified(sets, _spokes(starred))
    roots = components(linked(first))
    placed = _with_roots(_with_roots(starred.where(F.col("n") > 2), roots, "id", "own"), roots, "centre", "main")
    again = _with_centre(placed.where(F.col("own") != F.col("main")).select("key", "id"))
    second = verified(sets, _spokes(again).withColumn("many", F.lit(False)))
    links = linked(first).unionByName(linked(second))
    sizes = sets.groupBy("id").agg(F.max("size").alias("size"))
    # Components that are known are stars already, so only new links take rounds.
    roots = components(_star_edges(roots).unionByName(linked(second)))
    third = verified(sets, _open_pairs(first, sizes, roots))

    links = written(links.unionByName(linked(third)).distinct(), "links")
    copies = sketches.join(groups.drop("bands"), ["print1", "print2"]).select("id", "rep").distinct()
    copies = written(copies, "copies")
    many = copies.where(F.col("id") != F.col("rep")).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    roots = components(_star_edges(roots).unionByName(linked(third)).unionByName(many))
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degrees = ends.groupBy("u").agg(F.count_distinct("v").alias("links"))
    degree_of = copies.groupBy("id").agg(F.min("rep").alias("u")).join(degrees, "u", "left")
    classes = rows.select("id").distinct().join(roots.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.join(degree_of.select("id", "links"), "id", "left")
    return classes.select(
        F.col("id").alias(id_column), F.coalesce("root", "id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("verified_links"),
    )
