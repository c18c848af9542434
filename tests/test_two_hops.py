import random

import pytest

from ravelin.operators import graph as G
from ravelin.plans import graphs

H = "edge_id bigint, from_id string, to_id string, kind string, provenance_rank int, cost int, resolution string, bounded boolean"


def hops(spark, edges):
    return spark.createDataFrame([(i, a, b, "calls", 1, c, "resolved", False) for i, (a, b, c) in enumerate(edges)], H)


def shuffled(spark):
    """Bytes that were written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    each = context.statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.length()))


def test_ways_over_a_hub_are_not_shuffled(spark, monkeypatch):
    n_in, n_out, written = 400, 600, []
    edges = [(f"s{i}", "hub", 0) for i in range(n_in)] + [("hub", f"e{j}", 10) for j in range(n_out)] + [("s0", "e1", 0), ("s2", "x", 0), ("x", "e3", 0), ("hub", "s5", 0)]
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df, *done: written.append((out := cut(df, *done)).count()) or out)
    monkeypatch.setattr(graphs, "_hops", lambda spark, d: hops(spark, edges))
    monkeypatch.setattr(graphs, "_asked", lambda spark, d: spark.createDataFrame([(f"s{i}",) for i in range(n_in)], "id string"))
    before = shuffled(spark)
    out = graphs.simple_paths_all(spark, "").collect()
    assert max(written) < 0.1 * n_in * n_out and shuffled(spark) - before < 5 * n_in * n_out
    # every start reaches the hub and all behind it (s5 but for itself)
    assert len(out) == n_in * (n_out + 2) - 1 + 3
    assert {(r["depth"], r["cost"], r["path"]) for r in out if (r["start_id"], r["node_id"]) in {("s0", "e1"), ("s2", "e3")}} == {(1, 0, "s0 > e1"), (2, 10, "s0 > hub > e1"), (2, 0, "s2 > x > e3"), (2, 10, "s2 > hub > e3")}


@pytest.mark.parametrize("hub, cell, most", [(1, 2, 3), (3, 3, 2), (2, 500, 1), (1000, 512, 3)])
def test_best_two_hops_are_the_best_of_all_ways(spark, monkeypatch, hub, cell, most):
    """Several hubs that share starts and ends, links between them, circles, parallel links, self-loops, equal costs."""
    monkeypatch.setattr(G, "HUB", hub)
    monkeypatch.setattr(G, "CELL", cell)
    pick = random.Random(hub)
    names = [f"n{i}" for i in range(30)] + ["h1", "h2", "h3", "h"]
    edges = [(pick.choice(names), pick.choice(names), pick.choice([0, 10, 100])) for _ in range(60)]
    edges += [(pick.choice(names), h, pick.choice([0, 10])) for h in names[-4:] for _ in range(15)] + [(h, pick.choice(names), pick.choice([0, 100])) for h in names[-4:] for _ in range(15)]
    rows, starts = hops(spark, edges), spark.createDataFrame([(x,) for x in [*names[::2], "h1", "n0", "none", None]], "id string")
    want = sorted(tuple(r) for r in G.bounded_paths(G.simple_paths(rows, starts, 2), most).collect())
    got = sorted(tuple(r) for r in G.best_two_hops(rows, starts, most).collect())
    assert got == want and len(want) > 100
