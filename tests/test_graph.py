from ravelin.operators import graph as G

H = "edge_id bigint, from_id string, to_id string, kind string, provenance_rank int, cost int, resolution string, bounded boolean"


def hops(spark, *rows):
    return spark.createDataFrame([(i, a, b, k, 1, 0, "resolved", False) for i, (a, b, k) in enumerate(rows)], H)


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_impact_follows_containment_down_and_dependencies_back(spark):
    rows = hops(spark, ("m", "s", "contains"), ("s", "t", "contains"), ("u", "t", "calls"), ("v", "u", "references"), ("w", "v", "calls"), ("x", "w", "calls"), ("s", "m", "calls"), ("u", "u", "calls"), ("u", "t", "calls"), ("t", "q", "calls"))
    got = {r["id"]: r["distance"] for r in G.impact(rows, ids(spark, "m"), 3).collect()}
    assert got == {"s": 0, "t": 0, "u": 1, "v": 2, "w": 3}
    assert G.impact(rows, ids(spark), 2).collect() == []


def test_simple_paths_visit_no_node_twice(spark):
    rows = hops(spark, ("a", "b", "calls"), ("b", "a", "calls"), ("b", "c", "calls"), ("a", "c", "calls"), ("a", "a", "calls"), ("a", "b", "references"))
    got = {tuple(r["path"]) for r in G.simple_paths(rows, ids(spark, "a"), 3).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "b", "c")}


def test_bounded_paths_keep_the_cheapest(spark):
    paths = spark.createDataFrame([("a", "z", 1, 100, ["a", "z"]), ("a", "z", 2, 50, ["a", "b", "z"]), ("a", "z", 3, 0, ["a", "b", "c", "z"])], "start_id string, node_id string, depth int, cost int, path array<string>")
    assert {r["depth"] for r in G.bounded_paths(paths, 2).collect()} == {1, 3}
    assert {r["depth"] for r in G.bounded_paths(paths, 1).collect()} == {1}
    assert G.bounded_paths(paths, 3).count() == 3


def test_layers_leave_out_circles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), (None, "a"), ("d", None)], "before string, after string")
    assert {r["node"]: r["layer"] for r in G.layers(links).collect()} == {"a": 0, "b": 1, "c": 2}


def test_locate_prefers_exact(spark):
    nodes = spark.createDataFrame([("1", "a::b::c"), ("2", "c"), ("3", "x::d"), ("4", "y::d")], "id string, symbol string")
    values = spark.createDataFrame([("c",), ("d",), ("b::c",), ("zz",), (None,)], "value string")
    assert {tuple(r) for r in G.locate(values, nodes).collect()} == {("c", "2", True), ("d", "3", False), ("d", "4", False), ("b::c", "1", False)}


def test_enclosing_takes_the_smallest_span(spark):
    nodes = spark.createDataFrame([("big", "f", "fn", 1, 500), ("b", "f", "fn", 60, 70), ("a", "f", "fn", 60, 70), ("mod", "f", "module", 64, 64), ("g", "g", "fn", 1, 9)], "id string, file string, kind string, line_start int, line_end int")
    sites = spark.createDataFrame([(1, "f", 64), (2, "f", 200), (3, "f", 900), (4, None, 1), (5, "g", None)], "edge_id int, file string, line int")
    assert {tuple(r) for r in G.enclosing(sites, nodes).collect()} == {(1, "a"), (2, "big")}


def test_precedence_and_best(spark):
    rows = spark.createDataFrame([(1, "a", "b", "calls", 1, 0, "resolved", False), (2, "a", "b", "references", 3, 0, "resolved", False), (3, "a", "b", "contains", 1, 0, "resolved", False), (4, "a", "b", "calls", 1, 10, "unresolved", True)], H)
    assert {r["edge_id"] for r in G.preferred(rows).collect()} == {2, 3, 4}
    assert {(r["kind"], r["edge_id"]) for r in G.best_hops(rows).collect()} == {("calls", 1), ("references", 2), ("contains", 3)}


def test_stale_files(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "file string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1"), ("z", None)], "file string, hash string")
    assert {tuple(r) for r in G.stale_files(a, b).collect()} == {("y", "changed"), ("w", "added")}
