"""Circles of a directed relation: strongly connected components, in few rounds whatever the length of a chain or circle.

Each turn works on the links that are left:

1. Links whose start nothing leads to, or whose end leads nowhere, lie on no
   circle and go (one layer; chains are dealt with below).
2. Every node takes the smallest label that it reaches and the smallest that
   reaches it, for LABELS unrelated orders of the nodes at once.  A round passes
   labels on over the links and over a *jump*: a node also takes what the holder
   of its first label has.  That holder gets further away with every round, so
   ways double in length and rounds grow with the logarithm of the longest way.
3. Nodes whose first label is one both ways form a component (that of the label).
   All other links between nodes with different labels lie on no circle and go:
   LABELS labels each way cut a chain into some LABELS pieces or more, so the
   number of turns is a logarithm as well.

All steps are joins of long integers, whose right side has one row per node, so
that the rows of a node with a third of all links, or of a label that most nodes
share, are split by adaptive execution; minima are combined on the map side.
Only sums reach the driver, and nothing depends on how many links there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.session import cut

#: Orders of the nodes that are followed at once.
LABELS = 4
_ALL = [f"l{i}" for i in range(LABELS)]


def _trimmed(links: DataFrame) -> DataFrame:
    starts, ends = links.select(F.col("a").alias("b")).distinct(), links.select(F.col("b").alias("a")).distinct()
    return cut(links.join(starts, "b", "left_semi").join(ends, "a", "left_semi").select("a", "b"))


def _labels(links: DataFrame) -> DataFrame:
    """(node, low0.., high0..): the smallest labels that a node reaches, and the smallest that reach it; its own count as well.

    Label 0 is the node's number (numbers are given in an order unrelated to
    the links), the others are hashes, which only serve to tell nodes apart.
    A round is one join and one aggregation: ways are the links, the jump and
    the node itself.
    """
    # one graph for both ways: node v has the keys 2v and 2v + 1
    way = lambda k, to: F.struct(k.alias("k"), to.alias("to"))
    a, b = F.col("a"), F.col("b")
    ways = cut(links.select(F.explode(F.array(way(b * 2, a * 2), way(a * 2 + 1, b * 2 + 1))).alias("_w")).select("_w.*"))
    own = [F.col("k").alias("l0"), *[F.xxhash64(F.shiftright("k", 1), F.lit(i)).alias(f"l{i}") for i in range(1, LABELS)]]
    smallest = [F.min(c).alias(c) for c in _ALL]
    state, before = ways.select(F.explode(F.array("k", "to")).alias("k")).distinct().select("k", *own), None
    state = cut(state)
    while True:
        jumps = state.select(F.explode(F.array(way(F.col("l0"), F.col("k")), way(F.col("k"), F.col("k")))).alias("_w")).select("_w.*")
        met = ways.unionByName(jumps).join(state, "k").select(F.col("to").alias("k"), *_ALL)
        state = cut(met.groupBy("k").agg(*smallest), state)
        now = state.agg(*[F.sum(F.col(c).cast("decimal(20,0)")) for c in _ALL]).first()
        if now == before:
            break
        before = now
    side = lambda parity, name: [F.min(F.when(F.col("k") % 2 == parity, F.shiftright(c, 1) if c == "l0" else F.col(c))).alias(f"{name}{c[1:]}") for c in _ALL]
    return cut(state.groupBy(F.shiftright("k", 1).alias("node")).agg(*side(0, "low"), *side(1, "high")))


def _solved(links: DataFrame) -> DataFrame:
    """(node, component) of components of two nodes or more; ``links`` (a, b) are numbers, distinct and no loops."""
    found = links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    links = _trimmed(links)
    while links.limit(1).count():
        label = _labels(links)
        done = F.col("low0") == F.col("high0")
        one = label.where(done).select("node", F.col("low0").alias("component"))
        shared = one.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
        found = cut(found.unionByName(one.join(shared, "component", "left_semi").select("node", "component")))
        names = [f"{w}{i}" for w in ("low", "high") for i in range(LABELS)]
        at = lambda c: label.where(~done).select(F.col("node").alias(c), F.xxhash64(*names).alias(f"_{c}"))
        links = _trimmed(links.join(at("a"), "a").join(at("b"), "b").where(F.col("_a") == F.col("_b")).select("a", "b"))
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root_id) for every node that can reach itself over ``links`` (a, b); root_id: the smallest of its component.

    Null ends are no links; a link from a node to itself is a circle; no links, no rows.
    """
    links = cut(links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct())
    # numbers in an order that has nothing to do with the links
    mixed = links.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("_h", F.xxhash64("name")).repartition("_h").sortWithinPartitions("_h")
    nodes = cut(mixed.select("name", F.monotonically_increasing_id().alias("node")))
    number = lambda c: nodes.select(F.col("name").alias(c), F.col("node").alias(f"_{c}"))
    proper = links.where(F.col("a") != F.col("b")).join(number("a"), "a").join(number("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    named = cut(_solved(cut(proper)).join(nodes, "node").select("name", "component"))
    roots = named.groupBy("component").agg(F.min("name").alias("root_id"))
    members = named.join(roots, "component").select(F.col("name").alias("node"), "root_id")
    loops = links.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("root_id"))
    return members.unionByName(loops.join(members.select("node"), "node", "left_anti"))
