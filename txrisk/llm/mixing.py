"""Mixing sources to target weights: budgets down a tree, then a token-prefix of seeded epochs.

The tree's levels are columns (here domain, language, source); a leaf is one combination of them.
A leaf can give its tokens ``max_epochs`` times, an inner node what its children can give. From the
root down, a node's budget is dealt to its children by weight. A child that cannot use its share
takes all it can, and what it leaves goes to its siblings by weight; only what all siblings
together cannot use is missing from the node's own capacity, and so goes to the node's siblings
first and to farther relatives later. Weights are relative among siblings; a child without a
stated weight has weight 1, one with weight 0 gets nothing. Budgets are whole tokens; fractions are
cut, which leaves less than one token per child undealt.

A leaf with budget B and T tokens gives every document B // T times, and of the next epoch, ordered
by the seeded md5 of the document's id and the epoch, the shortest prefix with the rest of B tokens:
the document that crosses the border is kept whole.

A prefix is found without gathering a leaf: documents fall into buckets by the first digits of their
md5, token sums per bucket tell in which bucket the border lies, and rounds of further digits narrow
that bucket until a few documents are left to be ordered. This runs over stored rows of id, leaf and
token count; texts are read twice, to count their words and to choose them, and never shuffled, but
for copies of one row that the border falls between. All of it is DataFrame code.

Null level values form a leaf called ``unknown``. Tokens are whitespace-separated words; null and
empty texts have none, add nothing to a budget and come with their bucket. A leaf without any token
is used once, if its weights are above 0. Rows that repeat count each time; null ids share one place
in the order. An empty table gives no rows. All columns are kept, apart from ones called copy,
``__level1`` to ``__level3`` and ``__tokens``, which are set.
"""

from pyspark.sql import Window, functions as F

from txrisk.session import written

SEED = 17
MAX_EPOCHS = 3
LEVELS = ("__level1", "__level2", "__level3")


def token_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def epoch_digest(key, epoch, seed=SEED):
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), epoch.cast("string")))


def with_leaf(docs, levels, text_column="text"):
    """(own, levels, tokens): the document's own columns as one, so that no name can clash."""
    named = [F.coalesce(level.cast("string"), F.lit("unknown")).alias(name) for name, level in zip(LEVELS, levels)]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    return docs.select(own, *named, token_count(F.col(f"`{text_column}`")).alias("__tokens"))


def _weights(spark, weights, depth):
    """Weights of one level as a table (path columns, weight)."""
    rows = [(*path, float(weight)) for path, weight in weights.items() if len(path) == depth]
    fields = ", ".join(f"{name} STRING" for name in LEVELS[:depth])
    return spark.createDataFrame(rows, f"{fields}, weight DOUBLE")


def _dealt(children, parent):
    """Adds ``budget``: the parents' budgets (``given``) by weight, up to each child's capacity."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy("ratio", "name")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("given") - before) / weight_left
    usable = children.where(F.col("weight") > 0).withColumn("ratio", F.col("capacity") / F.col("weight"))
    filled = usable.withColumn("water", level)
    water = F.max(F.when(F.col("ratio") > F.col("water"), F.col("water"))).over(siblings)
    budget = F.when(F.col("ratio") <= F.col("water"), F.col("capacity")).otherwise(
        F.floor(F.col("mark") * F.col("weight"))
    )
    return filled.withColumn("mark", water).withColumn("budget", budget.cast("bigint"))


def leaf_budgets(leaves, weights, total_tokens=None, share=1.0, max_epochs=MAX_EPOCHS):
    """(levels, tokens, budget) for a table of leaves with their tokens.

    The budget of the root is ``total_tokens``, or ``share`` of all tokens where that is not given.
    Leaves without tokens have the budget 0, and are left out if a weight above them is 0.
    """
    spark = leaves.sparkSession
    tree = leaves
    for depth in (1, 2, 3):
        path = list(LEVELS[:depth])
        tree = tree.join(_weights(spark, weights, depth), path, "left").withColumn(
            f"weight{depth}", F.coalesce("weight", F.lit(1.0))
        ).drop("weight")
    used = F.when((F.col("weight1") > 0) & (F.col("weight2") > 0) & (F.col("weight3") > 0), F.col("tokens"))
    tree = tree.withColumn("capacity3", F.coalesce(used * max_epochs, F.lit(0)))
    one, two, three = ([*LEVELS[:depth]] for depth in (1, 2, 3))
    bare = tree.where((F.col("tokens") == 0) & used.isNotNull()).select(*three, "tokens", F.col("tokens").alias("budget"))
    tree = tree.where(F.col("tokens") > 0)
    domains = tree.groupBy(*one).agg(
        F.sum("capacity3").alias("capacity"), F.max("weight1").alias("weight"), F.sum("tokens").alias("__all")
    )
    whole = Window.partitionBy(F.lit(0))
    wanted = F.lit(total_tokens) if total_tokens is not None else F.floor(F.sum("__all").over(whole) * F.lit(share))
    given = F.least(wanted.cast("bigint"), F.sum("capacity").over(whole))
    domains = _dealt(domains.withColumns({"given": given, "name": F.col(LEVELS[0])}), [])
    languages = tree.groupBy(*two).agg(F.sum("capacity3").alias("capacity"), F.max("weight2").alias("weight"))
    languages = languages.join(domains.select(*one, F.col("budget").alias("given")), one)
    languages = _dealt(languages.withColumn("name", F.col(LEVELS[1])), one)
    sources = tree.select(*three, "tokens", F.col("capacity3").alias("capacity"), F.col("weight3").alias("weight"))
    sources = sources.join(languages.select(*two, F.col("budget").alias("given")), two)
    dealt = _dealt(sources.withColumn("name", F.col(LEVELS[2])), two).select(*three, "tokens", "budget")
    return dealt.unionByName(bare)


def _narrowed(rows, plan, digits):
    """``plan`` with the border bucket of each leaf narrowed by the next ``digits`` of the md5.

    ``rows`` are (levels, id, __tokens, __digest), ``plan`` has the border so far and the tokens before it.
    """
    joined = rows.join(plan, list(LEVELS)).where(F.startswith("__digest", "border"))
    sums = joined.groupBy(*LEVELS, F.expr("substring(__digest, 1, length(border) + %d)" % digits).alias("bucket")).agg(
        F.sum("__tokens").alias("held"), F.any_value("before").alias("begin"), F.any_value("rest").alias("rest")
    )
    running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum("held").over(running), F.lit(0))
    inside = sums.withColumn("before", before).where(F.col("before") <= F.col("rest"))
    last = inside.groupBy(*LEVELS).agg(F.max(F.struct("bucket", "before")).alias("last"))
    narrowed = last.select(*LEVELS, F.col("last.bucket").alias("border"), F.col("last.before").alias("before"))
    return written(plan.drop("border", "before").join(narrowed, list(LEVELS)), "leaf-borders")


def _cuts(rows, plan):
    """(levels, whole, rest, border, cut, first, tied): the last place of each leaf's prefix.

    ``first`` of the ``tied`` rows at that place belong to the prefix. Rows of one place count as
    one here, so an id that repeats without end is one row.
    """
    place = F.struct("__digest", "id", "__tokens").alias("place")
    at_border = rows.join(plan, list(LEVELS)).where(F.startswith("__digest", "border"))
    places = at_border.groupBy(*LEVELS, place, F.col("__tokens").alias("each")).agg(
        F.count(F.lit(1)).alias("tied"), F.any_value("before").alias("begin"), F.any_value("rest").alias("room")
    )
    in_order = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("begin") + F.coalesce(F.sum(F.col("tied") * F.col("each")).over(in_order), F.lit(0))
    left = F.col("room") - F.col("start")
    first = F.least("tied", F.coalesce(F.ceil(F.try_divide(left, F.col("each"))), F.col("tied"))).alias("first")
    inside = places.withColumn("start", start).where(left > 0).select(*LEVELS, "place", first, "tied")
    last = inside.groupBy(*LEVELS).agg(F.max(F.struct("place", "first", "tied")).alias("last"))
    cuts = last.select(*LEVELS, F.col("last.place").alias("cut"), "last.first", "last.tied")
    # A border bucket may begin where the prefix ends; all of the prefix is before it then.
    found = plan.join(cuts, list(LEVELS), "left")
    return written(found.select(*LEVELS, "whole", "rest", "border", "cut", "first", "tied"), "leaf-cuts")


def mix(docs, levels, weights, total_tokens=None, share=1.0, max_epochs=MAX_EPOCHS, seed=SEED, digits=3,
        id_column="doc_id", text_column="text"):
    """``docs`` with ``copy``: one row for each time a document is used, copies counted from 1.

    ``levels`` are three columns or expressions, ``weights`` a mapping of paths, such as
    ``("web", "en")``, to weights. ``digits`` are the hexadecimal digits of md5 that a round adds.
    """
    read = with_leaf(docs, levels, text_column)
    identity = F.col(f"own.`{id_column}`")
    narrow = written(read.select(identity.alias("id"), *LEVELS, "__tokens"), "leaf-rows")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = written(leaves, "leaves")
    budgets = leaf_budgets(leaves.drop("rows"), weights, total_tokens, share, max_epochs)
    bare = F.col("tokens") == 0
    plan = written(
        budgets.where(bare | (F.col("budget") > 0)).select(
            *LEVELS, F.when(bare, F.lit(1)).otherwise(F.floor(F.try_divide("budget", "tokens"))).alias("whole"),
            F.when(bare, F.lit(0)).otherwise(F.try_mod("budget", "tokens")).alias("rest"),
            F.lit("").alias("border"), F.lit(0).cast("bigint").alias("before"),
        ),
        "leaf-budgets",
    )
    keyed = narrow.join(plan.select(*LEVELS, "whole"), list(LEVELS))
    keyed = keyed.withColumn("__digest", epoch_digest(F.col("id"), F.col("whole"), seed)).drop("whole")
    largest = leaves.agg(F.max("rows")).head()[0] or 0
    plan = _narrowed(keyed, plan, digits)
    held = 16**digits
    while held < largest:  # a bucket holds about largest / held rows of a leaf
        plan, held = _narrowed(keyed, plan, digits), held * 16**digits
    cuts = _cuts(keyed, plan)

    rows = read.join(cuts, list(LEVELS)).withColumn("digest", epoch_digest(identity, F.col("whole"), seed))
    rows = rows.withColumn("place", F.struct(F.col("digest").alias("__digest"), identity.alias("id"), F.col("__tokens")))
    ahead = F.substring("digest", 1, F.length("border").cast("int")) < F.col("border")
    at_cut = F.col("place").eqNullSafe(F.col("cut"))
    split = F.coalesce(at_cut & (F.col("first") < F.col("tied")), F.lit(False))
    more = (F.col("rest") > 0) & (ahead | F.coalesce(F.col("place") <= F.col("cut"), F.lit(False)))
    among = Window.partitionBy(*LEVELS).orderBy(F.lit(0))
    tied = rows.where(split).withColumn("more", F.row_number().over(among) <= F.col("first"))
    chosen = rows.where(~split).withColumn("more", more).unionByName(tied)
    used = (F.col("whole") + F.col("more").cast("int")).cast("int")
    copies = F.explode(F.sequence(F.lit(1), used)).alias("copy")
    kept = [F.col(f"own.`{c}`") for c in docs.columns if c not in ("copy", "__tokens", *LEVELS)]
    return chosen.where(used > 0).select(*kept, *[F.col(c) for c in (*LEVELS, "__tokens")], copies)
