"""Parent-child links as full hierarchies: heavy paths after cycle separation.

1. *Sizes and circles.*  Every node keeps a pointer to its 2^j-th ancestor and
   the number of descendants fewer than 2^j links below it; one round doubles
   j.  A node whose pointer passes a root is done.  A round in which no node
   gets done means that all others run into circles, so circles are separated
   after log2(height) rounds, whatever the number of rows.
2. *Heavy paths.*  The child with the largest subtree continues its parent's
   chain, every other child begins a new one.  A way to the root changes chains
   at most log2(n) times.  Chain heads come from pointer doubling, too.
3. *Roll-out.*  Stretches of chains, not nodes, are resolved against each other
   (doubling again): depth, root, path of ids and the first preorder number.  A
   node's path is its stretch's path plus the part of the stretch before it; its
   descendants are the nodes with preorder numbers in [preorder, preorder + size).

Sums by ancestor are combined on the map side.  Joins on ancestors have the rows
of a hot ancestor (a node with a third of all children) on one side and a single
row on the other, which adaptive execution splits; where lists of ids are joined,
hot keys are salted.  Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.ids import clean_requirement_id
from ravelin.session import cut, salted_join

#: Nodes of a stretch of a chain at most, and preorder numbers of a block.
SEGMENT = BLOCK = 256


def parent_links(plan_edges: DataFrame, kind: str = "child") -> DataFrame:
    """(node, parent) of the rows of one kind with both ends, each child once (smallest parent if rows disagree)."""
    rows = plan_edges.where(F.col("kind") == kind).select(clean_requirement_id("to_id").alias("node"), clean_requirement_id("from_id").alias("parent"))
    return rows.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))


def _double(state: DataFrame, columns: list) -> DataFrame:
    """``state`` with the state of each row's ancestor beside it (prefix ``up_``); null for rows that are done.

    The join's right side has one row per node, so the rows of a hot ancestor
    are split by adaptive execution.
    """
    up = state.select(F.col("node").alias("_at"), *[F.col(c).alias(f"up_{c}") for c in columns])
    waiting = state.where(F.col("anc").isNotNull()).withColumn("_at", F.col("anc"))
    done = state.where(F.col("anc").isNull())
    for c, t in [(c, t) for c, t in state.dtypes if c in columns]:
        done = done.withColumn(f"up_{c}", F.lit(None).cast(t))
    return waiting.join(up, "_at", "left").drop("_at").unionByName(done)


def ends_and_sums(links: DataFrame, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, parent, end, sum) of the nodes whose way over ``links`` (node, parent) ends, and (node, parent) of those whose way doesn't.

    ``end`` is the last node of the way (a node without parent ends in
    itself), ``sum`` the weights (node, weight) of the node and all below it;
    without ``weights`` every node weighs 1.
    """
    nodes = links.select("node").unionByName(links.select(F.col("parent").alias("node"))).distinct()
    rows = nodes.join(links, "node", "left")
    rows = rows.withColumn("weight", F.lit(1).cast("long")) if weights is None else rows.join(weights, "node", "left")
    state = cut(rows.select("node", "parent", F.col("parent").alias("anc"), F.coalesce("parent", "node").alias("end"), F.coalesce("weight", F.lit(0)).alias("sum")))
    waiting = state.where(F.col("anc").isNotNull()).count()
    while waiting:
        # anc is the 2^j-th ancestor, sum counts those less than 2^j links below
        gained = state.where(F.col("anc").isNotNull()).groupBy("anc").agg(F.sum("sum").alias("_gain")).withColumnRenamed("anc", "node")
        doubled = _double(state, ["anc", "end"]).drop("anc").withColumnRenamed("up_anc", "anc")
        state = cut(doubled.join(gained, "node", "left").select("node", "parent", "anc", F.coalesce("up_end", "end").alias("end"), (F.col("sum") + F.coalesce("_gain", F.lit(0))).alias("sum")), state)
        left = state.where(F.col("anc").isNotNull()).count()
        if left == waiting:
            break
        waiting = left
    return state.where(F.col("anc").isNull()).drop("anc"), state.where(F.col("anc").isNotNull()).select("node", "parent")


def sizes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees as (node, parent, size), and the links on and below circles as (node, parent)."""
    trees, circles = ends_and_sums(links)
    return trees.select("node", "parent", F.col("sum").alias("size")), circles


def circle_roots(circles: DataFrame) -> DataFrame:
    """(node, root_id) for nodes whose way up never ends: the smallest id on the circle that it runs into."""
    state = cut(circles.select("node", F.col("parent").alias("anc")))
    if not state.limit(1).count():
        return state.select("node", F.col("anc").alias("root_id"))
    # the images of repeated doubling shrink to the nodes on circles
    landed, seen = state, state.select("anc").distinct().count()
    while True:
        landed = cut(_double(landed, ["anc"]).select("node", F.col("up_anc").alias("anc")))
        image = landed.select("anc").distinct().count()
        if image == seen:
            break
        seen = image
    on = cut(landed.select(F.col("anc").alias("node")).distinct().join(circles, "node").select("node", F.col("parent").alias("anc"), F.least("node", "parent").alias("low")))
    while True:
        after = cut(_double(on, ["anc", "low"]).select("node", F.col("up_anc").alias("anc"), F.least("low", "up_low").alias("low"), (F.col("up_low") < F.col("low")).alias("_moved")))
        moved = after.where("_moved").limit(1).count()
        on = after.drop("_moved")
        if not moved:
            break
    roots = on.select(F.col("node").alias("_end"), F.col("low").alias("root_id"))
    return landed.select("node", F.col("anc").alias("_end")).join(roots, "_end").select("node", "root_id")


def heavy_paths(trees: DataFrame) -> DataFrame:
    """(node, parent, size, head, pos): the chain (its topmost node) and the position on it; roots head a chain."""
    child = F.struct(F.col("size").alias("s"), F.col("node").alias("n"))
    heavy = trees.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.max(child).alias("_h")).select(F.col("_h.n").alias("node"), F.lit(True).alias("_heavy"))
    state = trees.join(heavy, "node", "left").select("node", "parent", "size", F.when(F.col("_heavy"), F.col("parent")).alias("anc"))
    state = cut(state.select("*", F.coalesce("anc", "node").alias("head"), F.when(F.col("anc").isNotNull(), 1).otherwise(0).cast("long").alias("pos")))
    while state.where(F.col("anc").isNotNull()).limit(1).count():
        both = _double(state, ["anc", "head", "pos"])
        state = cut(both.select("node", "parent", "size", F.col("up_anc").alias("anc"), F.coalesce("up_head", "head").alias("head"), (F.col("pos") + F.coalesce("up_pos", F.lit(0))).alias("pos")))
    return state.drop("anc")


def _light_offsets(placed: DataFrame) -> DataFrame:
    """(node, offset): how far a chain head's preorder number lies behind its parent's.

    Light siblings are ordered by (first two digits of the id's MD5, id); sums
    within these 256 buckets and over a parent's buckets keep a parent with
    very many children out of a single task.
    """
    heavy = placed.where(F.col("pos") > 0).select("parent", F.col("size").alias("_heavy_size"))
    light = placed.where((F.col("pos") == 0) & F.col("parent").isNotNull()).select("node", "parent", "size", F.substring(F.md5("node"), 1, 2).alias("_bucket"))
    totals = light.groupBy("parent", "_bucket").agg(F.sum("size").alias("_t"))
    before = Window.partitionBy("parent").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("parent", "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start")).join(heavy, "parent", "left")
    within = Window.partitionBy("parent", "_bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    inside = light.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = inside.join(starts, ["parent", "_bucket"])
    return joined.select("node", (F.lit(1) + F.coalesce("_heavy_size", F.lit(0)) + F.col("_start") + F.col("_inside")).alias("offset"))


def segments(placed: DataFrame, most: int = SEGMENT) -> DataFrame:
    """``placed`` with ``seg`` (the first node of its stretch of a chain) and ``rank`` (the place there); a stretch has ``most`` nodes at most."""
    rows = placed.withColumn("_part", F.floor(F.col("pos") / most)).withColumn("rank", F.pmod("pos", F.lit(most)))
    first = rows.where(F.col("rank") == 0).select("head", "_part", F.col("node").alias("seg"))
    return rows.join(first, ["head", "_part"]).drop("_part")


def roll_out(placed: DataFrame, paths: bool = True) -> DataFrame:
    """(node, root_id, depth, preorder, size[, path]) of all nodes from stretches of their chains.

    ``path`` lists the ids from the root to the node.  ``placed``: what
    :func:`heavy_paths` returns.  Chains are cut into stretches of bounded
    length, so no task holds a chain.
    """
    placed = cut(segments(placed))
    seat = placed.select(F.col("node").alias("parent"), F.col("seg").alias("anc"), F.col("rank").alias("_seat"))
    leaders = placed.where(F.col("rank") == 0).select("node", "parent", "pos").join(_light_offsets(placed), "node", "left")
    # a stretch: the one it hangs on (anc), links from there, preorder numbers from there, ids above it
    offset = F.when(F.col("pos") > 0, F.lit(1)).otherwise(F.col("offset"))
    stretches = salted_join(leaders.withColumn("offset", offset), seat, "parent", "left", F.col("node"))
    none = F.array().cast("array<string>")
    if paths:
        members = placed.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("_m")).select("seg", F.transform("_m", lambda m: m["node"]).alias("_ids"))
        ids = members.withColumnRenamed("seg", "anc")
        stretches = salted_join(stretches, ids, "anc", "left", F.col("node")).withColumn("above", F.when(F.col("anc").isNotNull(), F.slice("_ids", F.lit(1), F.col("_seat").cast("int") + 1)).otherwise(none)).drop("_ids")
    else:
        stretches = stretches.withColumn("above", none)
    zero = F.lit(0).cast("long")
    stretches = cut(stretches.select("node", "anc", F.coalesce(F.col("_seat") + 1, zero).alias("up"), F.coalesce(F.col("_seat") + F.col("offset"), zero).alias("pre"), F.coalesce("anc", "node").alias("root_id"), "above"))
    while stretches.where(F.col("anc").isNotNull()).limit(1).count():
        both = _double(stretches, ["anc", "up", "pre", "root_id", "above"])
        stretches = cut(both.select("node", F.col("up_anc").alias("anc"), (F.col("up") + F.coalesce("up_up", zero)).alias("up"), (F.col("pre") + F.coalesce("up_pre", zero)).alias("pre"), F.coalesce("up_root_id", "root_id").alias("root_id"), F.concat(F.coalesce("up_above", none), "above").alias("above")))
    top = stretches.select(F.col("node").alias("seg"), "up", "pre", "root_id", "above")
    out = placed.select("node", "seg", "rank", "size").join(top, "seg").select("node", "root_id", (F.col("up") + F.col("rank")).alias("depth"), (F.col("pre") + F.col("rank")).alias("preorder"), "size", "seg", "rank", "above")
    if not paths:
        return out.drop("seg", "rank", "above")
    whole = out.join(members, "seg").withColumn("path", F.concat("above", F.slice("_ids", F.lit(1), F.col("rank").cast("int") + 1)))
    return whole.select("node", "root_id", "depth", "preorder", "size", "path")


def tree_positions(plan_edges: DataFrame) -> DataFrame:
    """(node_id, root_id, depth) of every id on child links; depth -1 on and below circles."""
    trees, circles = sizes(parent_links(plan_edges))
    placed = roll_out(heavy_paths(trees), paths=False).select(F.col("node").alias("node_id"), "root_id", F.col("depth").cast("int").alias("depth"))
    return placed.unionByName(circle_roots(circles).select(F.col("node").alias("node_id"), "root_id", F.lit(-1).alias("depth")))


def tree_paths(plan_edges: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path, preorder, n_descendants): descendants hold the next n_descendants preorder numbers of the root's tree."""
    trees, _ = sizes(parent_links(plan_edges))
    rows = roll_out(heavy_paths(trees))
    return rows.select(F.col("node").alias("node_id"), "root_id", F.col("depth").cast("int").alias("depth"), F.array_join("path", " > ").alias("path"), "preorder", (F.col("size") - 1).alias("n_descendants"))


def tree_intervals(plan_edges: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, preorder, last): the descendants of a node are the nodes of its root with a preorder number behind its own, up to ``last``.

    One row per node holds both the membership (root_id, preorder) and the
    interval, so all descendants of all nodes come out without listing pairs.
    Preorder takes the child with the largest subtree first (largest id on
    ties), the others by the first two digits of the id's MD5, then by id.
    """
    trees, _ = sizes(parent_links(plan_edges))
    rows = roll_out(heavy_paths(trees), paths=False)
    return rows.select(F.col("node").alias("node_id"), "root_id", F.col("depth").cast("int").alias("depth"), "preorder", (F.col("preorder") + F.col("size") - 1).alias("last"))


def descendants_of(intervals: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of the wanted nodes (column node_id), from :func:`tree_intervals`.

    Preorder numbers are cut into blocks, so an interval meets its members by
    an equi-join on (root, block) with hot blocks bounded by BLOCK rows.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    ask = intervals.join(wanted.select("node_id").distinct(), "node_id", "left_semi").where(F.col("last") > F.col("preorder"))
    spans = ask.select(F.col("node_id").alias("ancestor_id"), "root_id", F.col("depth").alias("_d"), F.col("preorder").alias("_from"), F.col("last").alias("_to"), F.explode(F.sequence(block("preorder"), block("last"))).alias("_block"))
    members = intervals.select(F.col("node_id").alias("descendant_id"), "root_id", "depth", "preorder", block("preorder").alias("_block"))
    inside = spans.join(members, ["root_id", "_block"]).where((F.col("preorder") > F.col("_from")) & (F.col("preorder") <= F.col("_to")))
    return inside.select("ancestor_id", "descendant_id", (F.col("depth") - F.col("_d")).cast("int").alias("distance"))
