from ravelin.operators import context as C

H = "edge_id bigint, from_id string, to_id string, kind string, provenance_rank int, cost int, resolution string, bounded boolean"


def test_impact_candidates_reach_three_steps(spark):
    ways = [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")]
    hops = spark.createDataFrame([(i, x, y, "calls", 1, 0, "resolved", False) for i, (x, y) in enumerate(ways)], H)
    nodes = spark.createDataFrame([(x, f"k::{s}", "fn", "f") for x, s in zip("abcde", ["Alpha", "Bravo", "Charlie", "Delta", "Echo"])], "id string, symbol string, kind string, file string")
    got = C.candidates(hops, nodes, C.intent("callers of Alpha")).where("class = 'impact-path'")
    assert {r["id"]: r["score"] for r in got.collect()} == {"b": 825, "c": 750, "d": 675}
