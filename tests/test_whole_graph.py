import itertools

import pytest

import __spark_entry__ as e
from ravelin.operators import graph as G

H = "edge_id bigint, from_id string, to_id string, kind string, provenance_rank int, cost int, resolution string, bounded boolean"
EDGES = [("a", "b", 0), ("a", "b", 10), ("b", "c", 10), ("b", "a", 0), ("c", "b", 100), ("b", "b", 0), ("d", "b", 0), ("b", "e", 0), ("c", "d", 0), ("x", "c", 0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, a, b, "calls", 1, c, "resolved", False) for i, (a, b, c) in enumerate(EDGES)], H)


def test_flow_counts_are_all_pairs(spark, rows):
    best = {}
    for a, b, c in EDGES:
        best[a, b] = min(c, best.get((a, b), c))
    want = {}
    for (a, m), (n, b) in itertools.product(best, best):
        if m == n and len({a, m, b}) == 3 and m != "d":
            k = m, best[a, m] + best[n, b]
            want[k] = want.get(k, 0) + 1
    nodes = spark.createDataFrame([(x,) for x in "abcex"], "id string")
    assert {(r["through"], r["cost"]): r["n"] for r in G.flow_counts(rows, nodes).collect()} == want


def test_every_file_has_its_frontier(spark, rows):
    place = {"a": "f", "b": "g", "c": "g", "d": "h", "x": None}
    nodes = spark.createDataFrame(list(place.items()), "id string, file string")
    for most in (2048, 2):
        want = set()
        for f in ("f", "g", "h"):
            got = G.change_frontier(rows, nodes.where("file is not null"), spark.createDataFrame([(f,)], "file string"), most)
            want |= {(f, r["file"], r["reason"]) for r in got.collect()}
        assert {tuple(r) for r in G.change_frontiers(rows, nodes, most).select("changed", "file", "reason").collect()} == want


@pytest.mark.parametrize("whole, part", [("graph_references_all", "graph_references"), ("graph_change_frontier_all", "graph_change_frontier")])
def test_whole_queries_hold_more_than_one_file(spark, whole, part):
    from tests.conftest import DATA

    q = e.queries()
    small = q[part](spark, DATA)
    every = {tuple(r) for r in q[whole](spark, DATA).select(*small.columns).collect()}
    assert {tuple(r) for r in small.collect()} < every
