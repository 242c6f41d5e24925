"""Exact top-k by inner product with the three-phase uniform threshold (Cao and Wang, 2004).

A vector's dimensions are dealt to ``lists`` score lists: a score is the sum of its entries in all
lists. For each block of queries:

1. every task takes the ``k`` best entries of each local list and sends the exact scores of what it
   saw there; the k-th best of all of them is a safe cutoff, as at least k scores reach it;
2. the cutoff is broadcast, and every task collects the vectors that reach cutoff / lists in some
   list: a vector that doesn't cannot reach the cutoff in total;
3. the missing entries of these are added, which resolves their scores exactly, and each task sends
   its k best that reach the cutoff.

What is broadcast is one block of queries and one number for each, whatever the table's size. A
task sends k rows per query at most, so neither equal vectors nor ties make it send more.

Vectors are arrays of whole numbers. Null ids and null vectors take no part. A vector shorter than
a query counts as zero where it ends; an empty table gives no rows. Rows that repeat are listed as
often as they stand there, but no row with a query's own id is its candidate; of several queries
with one id the smallest vector counts. With fewer than k candidates all are listed. Ties go to the
smaller id. Scores must fit 64 bits. Other columns are ignored.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Window, functions as F

from txrisk.llm import vectors as V

register_pickle_by_value(sys.modules[__name__])

LISTS = 4
QUERY_BLOCK = 2048
ROWS, QUERIES_AT_ONCE = 1024, 256  # one tile of scores in a task
LOWEST = -(1 << 62)
FIELDS = "query_id BIGINT, vec_id BIGINT, score BIGINT"


def _tiles(tables, query_ids, queries, lists):
    """(first query, candidate ids, [entries of each list]) tile by tile; own ids are masked."""
    width = queries.shape[1]
    edges = np.linspace(0, width, lists + 1).astype(int)
    largest = np.abs(queries).max(initial=0)
    for table in tables:
        for first in range(0, table.num_rows, ROWS):
            ids = table.column(0).slice(first, ROWS).to_numpy()
            rows = V.matrix(table.column(1).slice(first, ROWS), np.int64, width)
            exact = float(largest) * float(np.abs(rows).max(initial=0)) * max(width, 1) < 2.0**53
            kind = np.float64 if exact else np.int64
            rows, asked = rows.astype(kind), queries.astype(kind)
            for q in range(0, len(queries), QUERIES_AT_ONCE):
                part = asked[q:q + QUERIES_AT_ONCE]
                entries = [
                    (part[:, a:b] @ rows[:, a:b].T).astype(np.int64) for a, b in zip(edges, edges[1:])
                ]
                own = query_ids[q:q + QUERIES_AT_ONCE, None] == ids[None, :]
                yield q, ids, entries, own


class _Best:
    """The k best (score, id) of every query seen so far."""

    def __init__(self, k):
        none = np.zeros(0, np.int64)
        self.k, self.rows, self.scores, self.ids = k, none, none, none

    def add(self, rows, scores, ids):
        rows, scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, ids])
        kept = V.best_per_row(rows, scores, ids, self.k)
        self.rows, self.scores, self.ids = rows[kept], scores[kept], ids[kept]

    def table(self, query_ids):
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[self.rows]), pa.array(self.ids), pa.array(self.scores)],
            names=["query_id", "vec_id", "score"],
        )


def _first_phase(block, k, lists):
    def gather(tables):
        query_ids, queries = block.value
        best = _Best(k)
        for q, ids, entries, own in _tiles(tables, query_ids, queries, lists):
            seen = np.zeros(own.shape, bool)
            top = min(k, own.shape[1])
            for entry in entries:
                entry = np.where(own, LOWEST, entry)
                places = np.argpartition(entry, -top, axis=1)[:, -top:]
                np.put_along_axis(seen, places, True, axis=1)
            rows, columns = np.nonzero(seen & ~own)
            best.add(rows + q, sum(entries)[rows, columns], ids[columns])
        yield best.table(query_ids)

    return gather


def _later_phases(block, cutoffs, k, lists):
    def resolve(tables):
        query_ids, queries = block.value
        least = cutoffs.value
        best = _Best(k)
        for q, ids, entries, own in _tiles(tables, query_ids, queries, lists):
            bound = least[q:q + QUERIES_AT_ONCE, None]
            share = -(-bound // lists)  # the smallest whole number that is at least bound / lists
            enough = np.zeros(own.shape, bool)
            for entry in entries:
                enough |= entry >= share
            rows, columns = np.nonzero(enough & ~own)
            scores = sum(entry[rows, columns] for entry in entries)
            kept = scores >= least[rows + q]
            rows, columns = rows[kept], columns[kept]
            if len(rows):
                best.add(rows + q, scores[kept], ids[columns])
        yield best.table(query_ids)

    return resolve


def _ranked(found, k):
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(candidates, queries, k=10, lists=LISTS, query_block=QUERY_BLOCK):
    """(query_id, rank, vec_id, score) for tables with vec_id and whole-number ``vector`` columns.

    Runs the first phase of every block of queries at once, the others when the result is read.
    """
    spark = candidates.sparkSession
    rows = candidates.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select("vec_id", "vector")
    asked = (
        queries.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .groupBy("vec_id").agg(F.min("vector").alias("vector"))
    )
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    results = []
    for number in range(blocks):
        table = asked.where(F.col("block") == number).select("vec_id", "vector").toArrow().combine_chunks()
        if table.num_rows == 0:
            continue
        ids = table.column(0).to_numpy()
        matrix = V.matrix(table.column(1).combine_chunks(), np.int64)
        block = spark.sparkContext.broadcast((ids, matrix))
        seen = _ranked(rows.mapInArrow(_first_phase(block, k, lists), FIELDS), k)
        kth = {r["query_id"]: r["score"] for r in seen.where(F.col("rank") == k).collect()}
        cutoffs = spark.sparkContext.broadcast(np.array([kth.get(i, LOWEST) for i in ids.tolist()], np.int64))
        found = rows.mapInArrow(_later_phases(block, cutoffs, k, lists), FIELDS)
        results.append(_ranked(found, k))
    if not results:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole.select("query_id", "rank", "vec_id", "score")


def scaled(embeddings, scale=1024, vector_column="embedding"):
    """(vec_id, vector) with each component x as floor(scale * x); unusable vectors are left out."""
    vector = F.col(f"`{vector_column}`")
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return embeddings.where(V.usable(vector)).select("vec_id", whole.alias("vector"))
