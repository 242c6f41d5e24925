"""Approximate nearest neighbours by inner product: one robust-pruned directed graph per shard.

Graphs are Vamana graphs (Subramanya and others, 2019). Points join in growing batches: a greedy
beam search from the medoid proposes neighbours, robust pruning keeps a near one and drops those
that are ``alpha`` times nearer to it than to the point, and edges are also laid back, pruning lists
that overflow. A query runs a beam search over every shard; the shards' best are ranked together.

The largest inner product is sought as the smallest Euclidean distance: every vector gets one more
component that makes all vectors of a shard equally long. A point whose nearest node is within
``RADIUS`` of that length joins this node instead of becoming one. So equal and nearly equal
vectors, be they a third of all rows, can't fill a beam; a search that meets a node ranks all its
members. Results are ranked by inner products of the original vectors in double precision, ties to
the smaller id.

The index covers every row; rows go to shards by a hash of id and vector, about ``shard_rows`` to
each. It is a table with one row per shard and can be stored. Queries go out in broadcasts of at
most ``query_block`` vectors.

Null ids and vectors that are null, zero or hold null or non-finite components take no part. Rows
that repeat both id and vector count once. A query's candidates are all rows with other ids; of
several queries with one id the smallest vector counts. Shorter vectors end in zeros. Fewer
candidates than k are all listed; empty tables give no rows. Other columns are ignored.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Window, functions as F

from txrisk.llm import vectors as V
from txrisk.session import written

register_pickle_by_value(sys.modules[__name__])

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, RADIUS = 28, 56, 96, 1.2, 0.3
SHARD_ROWS, QUERY_BLOCK, BATCH = 8192, 4096, 256
EXPANDED = 4  # nodes that a search opens in one step
PAIRS = 1 << 22  # distances between candidates held at once while pruning
RANKED = 1 << 17  # members ranked at once
INDEX = (
    "shard INT, nodes INT, width INT, vectors BINARY, neighbours BINARY, entry INT, member_counts BINARY, ids BINARY"
)
FOUND = "query_id BIGINT, vec_id BIGINT, score DOUBLE"


def lengthened(points):
    """Points with one more component, so that all are as long as the longest, as float32."""
    squares = (points * points).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    return np.column_stack([points, rest]).astype(np.float32)


def beam_search(points, graph, entry, asked, beam):
    """(nodes, squared distances) of the ``beam`` nearest nodes met, nearest first; -1 fills up."""
    b, norms = len(asked), (points * points).sum(axis=1)
    seen = np.zeros((b, len(points)), bool)
    nodes = np.full((b, beam), -1, np.int32)
    far = np.full((b, beam), np.inf, np.float32)
    opened = np.ones((b, beam), bool)
    nodes[:, 0], seen[:, entry], opened[:, 0] = entry, True, False
    own = (asked * asked).sum(axis=1)
    far[:, 0] = own + norms[entry] - 2 * (asked @ points[entry])
    active = np.arange(b)
    while len(active):
        waiting = np.where(opened[active], np.inf, far[active])
        place = np.argsort(waiting, axis=1)[:, :EXPANDED]
        ready = np.isfinite(np.take_along_axis(waiting, place, axis=1))
        going = ready[:, 0]
        active, place, ready = active[going], place[going], ready[going]
        if not len(active):
            break
        rows = np.repeat(active, ready.sum(axis=1))
        opened[rows, place[ready]] = True
        next_nodes = graph[nodes[rows, place[ready]]]
        pair = (rows[:, None] * np.int64(len(points)) + next_nodes)[next_nodes >= 0]
        pair = np.unique(pair)
        q, node = np.divmod(pair, len(points))
        fresh = ~seen[q, node]
        q, node = q[fresh], node[fresh]
        seen[q, node] = True
        distance = own[q] + norms[node] - 2 * np.einsum("ij,ij->i", asked[q], points[node])
        counts = np.bincount(q, minlength=b)[active]
        width = int(counts.max(initial=0))
        if width == 0:
            continue
        slot = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.searchsorted(active, q)
        more_nodes = np.full((len(active), width), -1, np.int32)
        more_far = np.full((len(active), width), np.inf, np.float32)
        more_nodes[at, slot], more_far[at, slot] = node, distance
        all_far = np.concatenate([far[active], more_far], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(all_far, order, axis=1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], more_nodes], axis=1), order, axis=1)
        closed = np.ones_like(more_nodes, bool) & (more_nodes < 0)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], closed], axis=1), order, axis=1)
    return nodes, far


def robust_prune(points, own, candidates, degree, alpha):
    """Neighbour lists for points ``own`` from padded ``candidates`` (-1 is empty)."""
    here = points[own]
    spots = points[np.maximum(candidates, 0)]
    away = ((spots - here[:, None, :]) ** 2).sum(axis=2)
    away[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(away, order, axis=1)
    spots = np.take_along_axis(spots, order[:, :, None], axis=1)
    lengths = (spots * spots).sum(axis=2)
    between = lengths[:, :, None] + lengths[:, None, :] - 2 * np.matmul(spots, spots.transpose(0, 2, 1))
    alive = np.isfinite(away)
    rows = np.arange(len(own))
    out = np.full((len(own), degree), -1, np.int32)
    for slot in range(degree):
        best = alive.argmax(axis=1)
        there = alive[rows, best]
        if not there.any():
            break
        out[there, slot] = candidates[rows, best][there]
        alive &= alpha * alpha * between[rows, best] > away
        alive[rows, best] = False
    return out


def _pruned_in_parts(points, own, candidates, degree, alpha):
    step = max(1, PAIRS // max(1, candidates.shape[1] ** 2))
    parts = [robust_prune(points, own[i:i + step], candidates[i:i + step], degree, alpha) for i in range(0, len(own), step)]
    return np.concatenate(parts)


def build_graph(points, degree=DEGREE, beam=BUILD_BEAM, alpha=ALPHA, radius=RADIUS, seed=7):
    """(neighbour lists, entry, node of each point); only points that are their own node have edges."""
    n = len(points)
    graph, node_of = np.full((n, degree), -1, np.int32), np.arange(n)
    near = radius * radius * float((points[0] * points[0]).sum())
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        joining = order[done:done + max(1, min(done, BATCH))]
        done += len(joining)
        found, far = beam_search(points, graph, entry, points[joining], beam)
        close = far[:, 0] <= near
        node_of[joining[close]] = found[close, 0]
        joining, found = joining[~close], found[~close]
        if not len(joining):
            continue
        graph[joining] = _pruned_in_parts(points, joining, found, degree, alpha)
        sources = np.repeat(joining, degree)
        targets = graph[joining].ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by_target = np.argsort(targets, kind="stable")
        sources, targets = sources[by_target], targets[by_target]
        changed, first, count = np.unique(targets, return_index=True, return_counts=True)
        held = (graph[changed] >= 0).sum(axis=1)
        room = held + count <= degree
        slot = np.arange(len(targets)) - np.repeat(first, count) + np.repeat(held, count)
        fits = np.repeat(room, count)
        graph[targets[fits], slot[fits]] = sources[fits]
        for size in np.unique(np.where(room, 0, 1 << np.ceil(np.log2(count)).astype(int))):
            if size == 0:
                continue
            group = np.flatnonzero(~room & (1 << np.ceil(np.log2(count)).astype(int) == size))
            wide = np.full((len(group), degree + size), -1, np.int32)
            wide[:, :degree] = graph[changed[group]]
            for row, g in enumerate(group):
                wide[row, degree:degree + count[g]] = sources[first[g]:first[g] + count[g]]
            graph[changed[group]] = _pruned_in_parts(points, changed[group], wide, degree, alpha)
    return graph, entry, node_of


def build_index(embeddings, vector_column="embedding", shard_rows=SHARD_ROWS):
    """The index of all usable rows as a table with one row per shard."""
    vector = F.col(f"`{vector_column}`")
    some = V.usable(vector) & F.exists(vector, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = embeddings.where(F.coalesce(some, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), vector.cast("array<double>").alias("vector")
    ).distinct()
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("vec_id").to_numpy()
        table = V.matrix(group.column("vector").combine_chunks(), np.float64)
        graph, entry, node_of = build_graph(lengthened(table))
        nodes, node = np.unique(node_of, return_inverse=True)
        number = np.full(len(table) + 1, -1, np.int32)  # the last place answers for "no neighbour"
        number[nodes] = np.arange(len(nodes))
        # A node's members lie together, the node's own vector first.
        order = np.lexsort((ids, node_of != np.arange(len(table)), node))
        row = {
            "shard": group.column("shard")[0].as_py(), "nodes": len(nodes), "width": table.shape[1],
            "vectors": table[order].tobytes(), "neighbours": number[graph[nodes]].tobytes(),
            "entry": int(number[entry]), "member_counts": np.bincount(node).astype(np.int64).tobytes(),
            "ids": ids[order].astype(np.int64).tobytes(),
        }
        kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int32()] + [pa.binary()] * 2
        return pa.Table.from_pylist([row], pa.schema(list(zip(row, kinds))))

    return dealt.groupBy("shard").applyInArrow(build, INDEX)


def _search_shards(block, k, beam):
    def search(tables):
        query_ids, queries = block.value
        for table in tables:
            for shard in table.to_pylist():
                n, width = shard["nodes"], shard["width"]
                vectors = np.frombuffer(shard["vectors"], np.float64).reshape(-1, width)
                graph = np.frombuffer(shard["neighbours"], np.int32).reshape(n, -1)
                counts = np.frombuffer(shard["member_counts"], np.int64)
                ids = np.frombuffer(shard["ids"], np.int64)
                starts = np.cumsum(counts) - counts
                points = lengthened(vectors)[starts]
                asked = np.zeros((len(queries), width))
                shared = min(width, queries.shape[1])
                asked[:, :shared] = queries[:, :shared]
                for q in range(0, len(asked), BATCH):
                    part = asked[q:q + BATCH]
                    extended = np.column_stack([part, np.zeros(len(part))]).astype(np.float32)
                    nodes, _ = beam_search(points, graph, shard["entry"], extended, max(beam, k))
                    held = np.where(nodes >= 0, counts[np.maximum(nodes, 0)], 0)
                    until = np.cumsum(held.sum(axis=1))
                    first = 0
                    while first < len(part):
                        met = until[first - 1] if first else 0
                        last = max(first + 1, int(np.searchsorted(until, met + RANKED, side="right")))
                        rows, slots = np.nonzero(nodes[first:last] >= 0)
                        node = nodes[first:last][rows, slots]
                        size, rows = counts[node], rows + first
                        place = np.repeat(starts[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
                        rows = np.repeat(rows, size)
                        other = ids[place] != query_ids[q + rows]
                        rows, place = rows[other], place[other]
                        scores = (vectors[place] * part[rows]).sum(axis=1)
                        best = V.best_per_row(rows, scores, ids[place], k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(query_ids[q + rows[best]]), pa.array(ids[place[best]]), pa.array(scores[best])],
                            names=["query_id", "vec_id", "score"],
                        )
                        first = last

    return search


def search(index, queries, k=20, vector_column="embedding", beam=SEARCH_BEAM, query_block=QUERY_BLOCK):
    """(query_id, rank, vec_id, score) of the nearest found; ``index`` comes from :func:`build_index`."""
    spark = index.sparkSession
    vector = F.col(f"`{vector_column}`")
    some = V.usable(vector) & F.exists(vector, lambda x: x != 0) & F.col("vec_id").isNotNull()
    asked = (
        queries.where(F.coalesce(some, F.lit(False)))
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.cast("array<double>").alias("vector"))
        .groupBy("vec_id").agg(F.min("vector").alias("vector"))
    )
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = spark.createDataFrame([], FOUND)
    for number in range(blocks):
        table = asked.where(F.col("block") == number).select("vec_id", "vector").toArrow().combine_chunks()
        if table.num_rows:
            block = spark.sparkContext.broadcast(
                (table.column(0).to_numpy(), V.matrix(table.column(1).combine_chunks(), np.float64))
            )
            found = found.unionByName(index.mapInArrow(_search_shards(block, k, beam), FOUND))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(embeddings, queries, k=20, vector_column="embedding"):
    """Builds and stores the index, then searches it."""
    index = written(build_index(embeddings, vector_column), "graph-index")
    return search(index, queries, k, vector_column)
