import random

from pyspark.sql import functions as F

from ravelin.operators import circles, hierarchy
from ravelin.session import hot_keys, salted_join


def links(spark, pairs):
    return spark.createDataFrame([(a, b, "child", 1) for a, b in pairs], "from_id string, to_id string, kind string, node_id int")


def brute(parents):
    out = {}
    for v in set(parents) | set(parents.values()):
        way, x = [v], v
        while x in parents and parents[x] not in way:
            x = parents[x]
            way.append(x)
        if x in parents:
            ring = way[way.index(parents[x]) :]
            out[v] = (min(ring), -1)
        else:
            out[v] = (x, len(way) - 1)
    return out


def forest(seed, n):
    rng = random.Random(seed)
    parents = {}
    for i in range(1, n):
        kind = rng.random()
        parents[f"N{i:03}"] = f"N{i - 1 if kind < 0.5 else 0 if kind < 0.7 else rng.randrange(i):03}"
    for i in rng.sample(range(1, n), 8):
        del parents[f"N{i:03}"]
    parents["C0"], parents["C1"], parents["C2"], parents["T1"], parents["T2"], parents["S"] = "C2", "C0", "C1", "C1", "T1", "S"
    return parents


def test_positions_against_brute_force(spark):
    parents = forest(3, 120)
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.tree_positions(links(spark, [(p, c) for c, p in parents.items()])).collect()}
    assert got == brute(parents)


def test_paths_intervals_and_descendants(spark):
    parents = {c: p for c, p in forest(4, 90).items() if c[0] == "N"}
    df = links(spark, [(f" {p.lower()}\t", c) for c, p in parents.items()])
    rows = {r["node_id"]: r for r in hierarchy.tree_paths(df).collect()}
    below = {v: set() for v in rows}
    for v, r in rows.items():
        way = r["path"].split(" > ")
        assert way[0] == r["root_id"] and way[-1] == v and len(way) == r["depth"] + 1
        assert all(parents[b] == a for a, b in zip(way, way[1:]))
        for a in way[:-1]:
            below[a].add(v)
    for v, r in rows.items():
        inside = {w for w, s in rows.items() if s["root_id"] == r["root_id"] and r["preorder"] < s["preorder"] <= r["preorder"] + r["n_descendants"]}
        assert inside == below[v] and len(inside) == r["n_descendants"]
    intervals = hierarchy.tree_intervals(df)
    pairs = {(r["ancestor_id"], r["descendant_id"]) for r in hierarchy.descendants_of(intervals, intervals).collect()}
    assert pairs == {(a, w) for a, ws in below.items() for w in ws}


def test_long_chain_is_cut_into_stretches(spark):
    """A chain of 700 with side branches: three stretches, paths and intervals as ever."""
    parents = {f"c{i:04}": f"c{i - 1:04}" for i in range(1, 700)} | {f"x{i}": f"c{i * 60:04}" for i in range(11)}
    rows = {r["node_id"]: r for r in hierarchy.tree_paths(links(spark, [(p, c) for c, p in parents.items()])).collect()}
    assert rows["C0699"]["depth"] == 699 and rows["C0699"]["path"].split(" > ") == [f"C{i:04}" for i in range(700)]
    assert sorted(r["preorder"] for r in rows.values()) == list(range(711))
    for i in range(11):
        assert rows[f"X{i}"]["depth"] == 60 * i + 1 and rows[f"X{i}"]["n_descendants"] == 0
        assert rows[f"C{i * 60:04}"]["n_descendants"] == 699 - 60 * i + 11 - i


def test_no_links_and_nulls(spark):
    assert hierarchy.tree_positions(links(spark, [])).collect() == []
    assert hierarchy.tree_positions(links(spark, [("a", None), (None, "b"), (" ", "c")])).collect() == []


def test_components_against_brute_force(spark):
    rng = random.Random(9)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)} | {(50, 50), (60, 61), (61, 60)}
    df = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in pairs] + [(None, "01"), ("01", None)], "a string, b string")
    reach = {x: {b for a, b in pairs if a == x} for x in range(70)}
    for _ in range(70):
        for x in reach:
            reach[x] |= {z for y in reach[x] for z in reach.get(y, ())}
    want = {f"{x:02}": f"{min(y for y in reach[x] if x in reach[y]):02}" for x in reach if x in reach[x]}
    assert {r["node"]: r["root_id"] for r in circles.components(df).collect()} == want
    assert circles.components(df.limit(0)).collect() == []


def test_dense_components_against_brute_force(spark):
    """Every node with two links out or more, so that labels do the work; several components over one another."""
    rng = random.Random(5)
    pairs = {(a, rng.randrange(a // 12 * 12, a // 12 * 12 + 12)) for a in range(72) for _ in range(3)} | {(a, rng.randrange(a // 12 * 12, 72)) for a in range(72)}
    reach = {x: {b for a, b in pairs if a == x} for x in range(72)}
    for _ in range(72):
        for x in reach:
            reach[x] |= {z for y in reach[x] for z in reach[y]}
    want = {f"{x:02}": f"{min(y for y in reach[x] if x in reach[y]):02}" for x in reach if x in reach[x]}
    df = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in pairs], "a string, b string")
    assert {r["node"]: r["root_id"] for r in circles.components(df).collect()} == want


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 1,500 and a circle of 5,000 links: few cuts, each a round or a step of one."""
    seen = []
    plain = circles.cut
    monkeypatch.setattr(circles, "cut", lambda *x: seen.append(1) or plain(*x))
    ids = [f"{i * 7919 % 5000:04}" for i in range(5000)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a string, b string")
    assert circles.components(frame(list(zip(ids[:1500], ids[1:1501])))).collect() == []
    assert len(seen) < 200
    seen.clear()
    ring = circles.components(frame(list(zip(ids, ids[1:] + ids[:1])))).collect()
    assert {r["root_id"] for r in ring} == {"0000"} and len(ring) == 5000 and len(seen) < 100


def test_salted_join_takes_its_hot_path(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k3", "c"), (None, "d")], "k string, w string")
    assert hot_keys(left, "k") == ["hot"] and hot_keys(left.limit(0), "k") == []
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(left, right, "k", how, F.col("v"))
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
