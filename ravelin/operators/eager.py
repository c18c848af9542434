"""Eager aggregation through joins, and the degrees of a graph with a few very heavy nodes.

``SELECT g, count(*), sum(l.v), sum(r.w) FROM l JOIN r USING (k) GROUP BY g``
over uneven keys would send all pairs of a heavy key to one task.  Here both
inputs are aggregated by join key first (map-side, so a heavy key leaves each
map task as a single row), the compact states are joined, and the totals follow
from them: the pairs of a key are the product of its two counts, a sum of one
side counts once per row of the other.  A last roll-up adds up the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.ids import clean_id
from ravelin.session import cut
from ravelin.sources.tables import earliest

INCOMING, OUTGOING, ALL_EDGES = "incoming", "outgoing", "edges"


def eager_join(left: DataFrame, right: DataFrame, on: list[str], left_groups: list[str] = (), right_groups: list[str] = (), left_sums: list[str] = (), right_sums: list[str] = (), outer: bool = False) -> DataFrame:
    """The grouped inner (``outer``: left) join of two inputs without joining their rows.

    Returns ``left_groups``, ``right_groups``, ``pairs`` (joined rows) and the
    sums, named ``sum_<column>``.  Null keys match nothing; null values add
    nothing; empty inputs give no rows.  ``outer`` keeps left rows without a
    partner: each counts as one pair with null right columns.  Names of the
    two sides may clash; other columns are ignored.
    """
    left_groups, right_groups, left_sums, right_sums = map(list, (left_groups, right_groups, left_sums, right_sums))
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]
    l_keys, r_keys = [f"_k{i}" for i in range(len(on))], [f"_j{i}" for i in range(len(on))]
    l = left.select(*keys, *[F.col(g).alias(f"_lg_{g}") for g in left_groups], *[F.col(v).alias(f"_lv_{v}") for v in left_sums])
    l = l.groupBy(*l_keys, *[f"_lg_{g}" for g in left_groups]).agg(F.count("*").alias("_ln"), *[F.sum(f"_lv_{v}").alias(f"_ls_{v}") for v in left_sums])
    r = right.select(*[F.col(k).alias(j) for k, j in zip(on, r_keys)], *[F.col(g).alias(f"_rg_{g}") for g in right_groups], *[F.col(v).alias(f"_rv_{v}") for v in right_sums])
    r = r.dropna(subset=r_keys).groupBy(*r_keys, *[f"_rg_{g}" for g in right_groups]).agg(F.count("*").alias("_rn"), *[F.sum(f"_rv_{v}").alias(f"_rs_{v}") for v in right_sums])
    if not outer:
        l = l.dropna(subset=l_keys)
    condition = None
    for a, b in zip(l_keys, r_keys):
        condition = (F.col(a) == F.col(b)) if condition is None else condition & (F.col(a) == F.col(b))
    joined = l.join(r, condition, "left" if outer else "inner")
    rn = F.coalesce(F.col("_rn"), F.lit(1))
    groups = [F.col(f"_lg_{g}").alias(g) for g in left_groups] + [F.col(f"_rg_{g}").alias(f"right_{g}" if g in left_groups else g) for g in right_groups]
    return joined.groupBy(*groups).agg(
        F.sum(F.col("_ln") * rn).alias("pairs"),
        *[F.sum(F.col(f"_ls_{v}") * rn).alias(f"sum_{v}") for v in left_sums],
        *[F.sum(F.col(f"_rs_{v}") * F.col("_ln")).alias(f"right_sum_{v}" if v in left_sums else f"sum_{v}") for v in right_sums],
    )


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, from_id, kind, targets) per edge_id: what the degrees need; a redelivered edge counts from its earliest arrival."""
    rows = edges.select("edge_id", "arrived_at", clean_id("from_id").alias("from_id"), clean_id("to_id").alias("to_id"), "resolution", "kind", "candidates")
    rows = rows.select("edge_id", "arrived_at", "from_id", "kind", edge_targets().alias("targets"))
    return earliest(rows, "edge_id", ["edge_id", "from_id", "kind", "targets"])


def edge_targets() -> Column:
    """Target ids of an edge, each once: none if external, the candidates if unresolved with any, else to_id."""
    candidates = F.array_distinct(F.filter(F.transform(F.coalesce("candidates", F.array().cast("array<string>")), clean_id), lambda x: x.isNotNull()))
    to = F.when(F.col("to_id").isNotNull(), F.array("to_id")).otherwise(F.array().cast("array<string>"))
    unresolved = F.col("resolution") == "unresolved"
    some = F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 0
    return F.when(unresolved & some, candidates).when(unresolved | (F.col("resolution") == "resolved"), to).otherwise(F.array().cast("array<string>"))


def list_states(edges: DataFrame) -> DataFrame:
    """Compact states (direction, ids, kind, n): distinct edges per list of end nodes, counted before any list meets its nodes.

    The row with direction ``edges`` holds the number E of distinct edges per
    kind.  Null or blank node ids are no keys; an edge without edge_id isn't
    counted; a null kind is a kind of its own.
    """
    entry = lambda direction, ids: F.struct(F.lit(direction).alias("direction"), ids.alias("ids"))
    every = F.array(entry(ALL_EDGES, F.array().cast("array<string>")), entry(OUTGOING, F.array("from_id")), entry(INCOMING, F.col("targets")))
    lists = distinct_edges(edges).select("kind", F.explode(every).alias("_e")).select("_e.*", "kind")
    named = lists.where((F.col("direction") == ALL_EDGES) | ((F.size("ids") > 0) & F.get("ids", F.lit(0)).isNotNull()))
    return cut(named.groupBy("direction", "ids", "kind").agg(F.count("*").alias("n")))


def degree_states(states: DataFrame, by_kind: bool = True) -> DataFrame:
    """(direction, node_id[, kind], n) from :func:`list_states`: the eager join of edges with the nodes of their lists, rolled up.

    A list of one node is that node's own state.  Lists of several, already
    counted per list, meet their members in an eager join: the edges of a list
    count once for each member, as a product of states.
    """
    kind = ["kind"] if by_kind else []
    ends = states.where(F.col("direction") != ALL_EDGES)
    single = ends.where(F.size("ids") == 1).select("direction", F.get("ids", F.lit(0)).alias("node_id"), *kind, "n")
    several = ends.where(F.size("ids") > 1)
    members = several.select("ids").distinct().select("ids", F.explode("ids").alias("node_id"))
    met = eager_join(several, members, ["ids"], ["direction", *kind], ["node_id"], ["n"]).select("direction", "node_id", *kind, F.col("sum_n").alias("n"))
    return single.unionByName(met).groupBy("direction", "node_id", *kind).agg(F.sum("n").alias("n"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """(node_id, n_in, n_out, through) for every node with an edge, ``through`` being the two-hop paths over it.

    Both adjacency lists are aggregated by node before they meet, so the
    n_in * n_out paths over a heavy node are a product and never rows.
    """
    degrees = degree_states(list_states(edges), by_kind=False)
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("n"))), F.lit(0))
    both = degrees.groupBy("node_id").agg(side(INCOMING).alias("n_in"), side(OUTGOING).alias("n_out"))
    return both.withColumn("through", F.col("n_in") * F.col("n_out"))


def heavy_nodes(edges: DataFrame, share: int = 100) -> DataFrame:
    """(node_id, direction) with at least E / ``share`` edges, E being all distinct edges; no edges, no rows."""
    states = list_states(edges)
    total = states.where(F.col("direction") == ALL_EDGES).agg(F.sum("n")).first()[0] or 0
    return degree_states(states, by_kind=False).where(F.col("n") * share >= total).select("node_id", "direction")


def degrees_by_kind(edges: DataFrame) -> DataFrame:
    """(node_id, direction, kind, n_edges): the full lists' lengths, split by kind."""
    return degree_states(list_states(edges)).select("node_id", "direction", "kind", F.col("n").alias("n_edges"))


def file_traffic(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, kind, n_edges): edges into the nodes of each file, by an eager join of edge targets with nodes.

    A node counts in each distinct file its rows name; targets that are no node count under a null file.
    """
    targets = distinct_edges(edges).select("kind", F.explode("targets").alias("node_id"))
    places = nodes.select(clean_id("id").alias("node_id"), "file").distinct()
    return eager_join(targets, places, ["node_id"], ["kind"], ["file"], outer=True).select("file", "kind", F.col("pairs").alias("n_edges"))
