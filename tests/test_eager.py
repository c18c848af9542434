from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ravelin.operators import eager
from ravelin.sources.tables import earliest

EDGES = "edge_id bigint, from_id string, to_id string, resolution string, kind string, candidates array<string>, arrived_at timestamp, file string"


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, r, k, c, None, "x") for i, a, b, r, k, c in rows], EDGES)


def test_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 7 else None, "ab"[i % 2], i) for i in range(60)] + [(0, None, None)], "k int, g string, v int")
    right = spark.createDataFrame([(i % 4, "xyz"[i % 3], 10 * i) for i in range(40)] + [(None, "x", 1)], "k int, g string, v int")
    got = {(r["g"], r["right_g"]): (r["pairs"], r["sum_v"], r["right_sum_v"]) for r in eager.eager_join(left, right, ["k"], ["g"], ["g"], ["v"], ["v"]).collect()}
    plain = left.alias("a").join(right.alias("b"), F.col("a.k") == F.col("b.k")).groupBy(F.col("a.g").alias("g"), F.col("b.g").alias("h")).agg(F.count("*").alias("n"), F.sum("a.v").alias("s"), F.sum("b.v").alias("t"))
    assert got == {(r["g"], r["h"]): (r["n"], r["s"], r["t"]) for r in plain.collect()}


def test_join_of_nothing_and_outer(spark):
    left = spark.createDataFrame([(1, "a"), (None, "a"), (2, "b")], "k int, g string")
    none = left.limit(0)
    assert eager.eager_join(left, none, ["k"], ["g"]).collect() == []
    got = {r["g"]: r["pairs"] for r in eager.eager_join(left, none, ["k"], ["g"], outer=True).collect()}
    assert got == {"a": 2, "b": 1}


def test_degrees_count_each_edge_once(spark):
    rows = [(1, "a", "b", "resolved", "calls", None), (1, "a", "b", "resolved", "calls", None), (2, "a", " b ", "resolved", None, []), (3, "a", None, "unresolved", "calls", ["b", "c", "b ", None]), (4, "a", "x", "external", "calls", ["q"]), (5, "a", "d", "unresolved", "calls", []), (None, "z", "z", "resolved", "calls", None), (6, None, "b", "resolved", "calls", None), (7, "b", "b", "resolved", "calls", ["c"])]
    got = Counter({(r["node_id"], r["direction"], r["kind"]): r["n_edges"] for r in eager.degrees_by_kind(edges(spark, rows)).collect()})
    assert got == {("a", "outgoing", "calls"): 4, ("a", "outgoing", None): 1, ("b", "outgoing", "calls"): 1, ("b", "incoming", "calls"): 4, ("b", "incoming", None): 1, ("c", "incoming", "calls"): 1, ("d", "incoming", "calls"): 1}


def test_through_is_a_product_and_heavy_nodes(spark):
    rows = [(i, f"s{i}", "hub", "resolved", "calls", None) for i in range(300)] + [(1000 + i, "hub", f"t{i}", "resolved", "calls", None) for i in range(50)]
    df = edges(spark, rows)
    through = {r["node_id"]: r["through"] for r in eager.node_degrees(df).collect()}
    assert through["hub"] == 300 * 50 and through["s1"] == 0
    assert {tuple(r) for r in eager.heavy_nodes(df).collect()} == {("hub", "incoming"), ("hub", "outgoing")}
    assert eager.heavy_nodes(df.limit(0)).collect() == []


def test_file_traffic(spark):
    nodes = spark.createDataFrame([("b", "f1"), ("b", "f2"), ("b", "f1"), (None, "f3")], "id string, file string")
    got = defaultdict(int)
    for r in eager.file_traffic(edges(spark, [(1, "a", "b", "resolved", "calls", None), (2, "a", "q", "resolved", "calls", None)]), nodes).collect():
        got[r["file"]] += r["n_edges"]
    assert got == {"f1": 1, "f2": 1, None: 1}


def test_earliest_of_ties_and_missing_times(spark):
    df = spark.createDataFrame([(1, None, "z"), (1, 5, "y"), (1, 5, "x"), (2, None, "q"), (None, 1, "n")], "k int, arrived_at int, v string")
    assert {(r["k"], r["v"]) for r in earliest(df, "k", ["k", "v"]).collect()} == {(1, "x"), (2, "q")}
