"""A Merkle manifest of a table: every row a leaf, a tree per group, a tree over the groups' roots.

Nodes of a tree stand in rows ordered by position; every ``arity`` consecutive ones become their
parent, a last run may be shorter. On the rows of one block of ``arity ** levels`` leaves, level after
level, lag and lead columns at fixed offsets (multiples of the level's stride), masked by the slot
in the run and by the tree's length, supply the siblings, and the first-child rows hash the
parents. The row where a block begins ends up with the block's own node, and blocks are the leaves
of the next tier, so a tree of n leaves takes log(n) / log(block) tiers. Siblings stand on the first
row of each node; a running ``last`` brings them to all rows below.

No task holds more than a block of a group, whatever the group's size: positions come from a range
sort by (group, order, leaf) with counts per range, blocks are the only window partitions, and rows
meet the upper tiers by block. Everything is DataFrame code.

A field is ``-`` if null, else its length in UTF-8 bytes, ``:`` and its text. Null groups are a group
of their own, before all others; groups are ordered by UTF-8 bytes. Null order values come first.
Rows that repeat an order value are ordered by their leaf; equal rows are leaves each, and which of
them stands where makes no difference to the set of result rows. Empty and very long texts are
fields like any other. An empty table gives no rows. Columns that are not named are ignored, so
their names cannot clash.
"""

from pyspark.sql import Window, functions as F

from txrisk.session import written

ARITY, LEVELS = 2, 10


def field(column):
    """A column's value as it enters a leaf."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts):
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*columns):
    return digest(*map(field, columns))


def _placed(nodes, *order):
    """(nodes with ``pos`` in their tree, by ``order``, and the tree's ``size``; the largest size).

    A stored range sort numbers the rows of each of its parts; where a tree begins in a part follows
    from the trees' counts by part, a table of one row per tree and one more per border of parts.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    stored = written(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    stored = stored.withColumn("part", F.shiftright("at", 33))
    own = Window.partitionBy("tree")
    runs = stored.groupBy("tree", "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n")).select(
        "tree", "part", "begin",
        F.coalesce(
            F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
        F.sum("n").over(own).alias("size"),
    )
    runs = written(runs, "merkle-runs")
    placed = stored.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("begin") + F.col("before"))
    return placed.drop("at", "part", "begin", "before"), runs.agg(F.max("size")).head()[0] or 0


def _climbed(nodes, arity, levels):
    """Nodes of each row at every level of its block, and the siblings left and right of them.

    One SQL text, so that the nested windows are analysed once and not once more per level.
    """
    text = f"SELECT *, pos div {arity ** levels} AS block, digest AS node_0 FROM {{nodes}}"
    for level in range(levels):
        stride, node = arity**level, f"node_{level}"
        slot = f"pos div {stride} % {arity}"
        left = [
            f"CASE WHEN {slot} >= {m} THEN lag({node}, {m * stride}) OVER own END" for m in range(arity - 1, 0, -1)
        ]
        right = [
            f"CASE WHEN {slot} + {m} < {arity} AND pos + {m * stride} < size THEN lead({node}, {m * stride}) OVER own END"
            for m in range(1, arity)
        ]
        text = f"""
            SELECT *, {_joined(left)} AS left_{level}, {_joined(right)} AS right_{level} FROM ({text})
            WINDOW own AS (PARTITION BY tree, block ORDER BY pos)"""
        # Where the tree has one node left, it stays.
        text = f"""
            SELECT *, CASE WHEN size <= {stride} THEN {node}
                WHEN {slot} = 0 THEN sha2({node} || right_{level}, 256) END AS node_{level + 1} FROM ({text})"""
    return nodes.sparkSession.sql(text, nodes=nodes)


def _joined(siblings):
    return " || ".join(f"coalesce({s}, '')" for s in siblings)


def _parents(nodes, arity, levels):
    """The blocks' nodes: the next tier."""
    size = arity**levels
    return _climbed(nodes, arity, levels).where(F.col("pos") % size == 0).select(
        "tree", F.col("block").alias("pos"), F.expr(f"(size + {size - 1}) div {size}").alias("size"),
        F.col(f"node_{levels}").alias("digest"),
    )


def _siblings(nodes, arity, levels):
    """Each row's siblings from its own level up to its block's, without levels its tree lacks."""
    so_far = Window.partitionBy("tree", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows, steps = _climbed(nodes, arity, levels), []
    for level in range(levels):
        begins = (F.col("pos") % arity**level == 0) & (F.col("size") > arity**level)
        both = F.struct(F.col(f"left_{level}").alias("left"), F.col(f"right_{level}").alias("right"))
        steps.append(F.last(F.when(begins, both), ignorenulls=True).over(so_far))
    path = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return rows.select(*nodes.columns, "block", path.alias("own_path"))


def _climb(nodes, largest, arity, levels, above=None):
    """The nodes with their tree's root as ``subroot`` and the siblings on the way to it as ``path``.

    ``largest`` is the number of nodes of the largest tree; it says how many tiers there are.
    ``above`` maps the trees' roots to their (tree, path, root) further up.
    """
    tiers, heights = [nodes], []
    while not heights or largest > 1:
        height = 1
        while height < levels and arity**height < largest:
            height += 1
        heights.append(height)
        tiers.append(written(_parents(tiers[-1], arity, height), "merkle-tier"))
        largest = -(-largest // arity**height)
    trees = tiers.pop().select("tree", "pos", F.col("digest").alias("subroot"))
    if above:
        known = trees.join(above(trees.select("tree", F.col("subroot").alias("digest"))), "tree")
    else:
        known = trees.withColumn("path", F.expr("CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"))
    while tiers:
        tier = tiers.pop()
        upper = known.withColumnsRenamed({"pos": "block", "path": "upper"})
        known = _siblings(tier, arity, heights[len(tiers)]).join(upper, ["tree", "block"]).withColumn(
            "path", F.concat("own_path", "upper")
        ).drop("block", "own_path", "upper", "size")
        if tiers:
            known = written(known.drop("digest"), "merkle-paths")
    return known


def manifest(rows, columns, group_column, order_column, arity=ARITY, levels=LEVELS, **carried):
    """(carried columns, leaf, subroot, root, path) of every row.

    ``carried`` names columns of the result by expressions over the rows; without any it is the order
    column. ``path`` lists, from the leaf
    to the root, the digests ``left`` and ``right`` of the node among its siblings.
    """
    def above(trees):
        named = trees.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("group"))
        top = _climb(*_placed(named, "group"), arity, levels)
        return top.select(F.col("group").alias("tree"), "path", F.col("subroot").alias("root"))

    carried = carried or {order_column: F.col(f"`{order_column}`")}
    group = F.col(f"`{group_column}`").cast("string")
    leaves = rows.select(
        # never null, and in the order of the groups, null first
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("tree"),
        F.col(f"`{order_column}`").alias("place"),
        leaf_of(*[F.col(f"`{c}`") for c in columns]).alias("digest"),
        F.struct(*[c.alias(name) for name, c in carried.items()]).alias("carried"),
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart, so they can be split
    )
    nodes, largest = _placed(written(leaves, "merkle-leaves"), "place", "digest", "row")
    found = _climb(nodes.drop("place", "row"), largest, arity, levels, above)
    return found.select("carried.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof_digest(path):
    """One digest over all siblings, level by level, left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), ""))


def folded(leaf, path):
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))
