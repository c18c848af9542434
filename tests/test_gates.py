from pyspark.sql import functions as F

from ravelin.operators import gates as G
from ravelin.operators import graph


def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def test_critical_gate_and_failures(spark):
    s = spark.createDataFrame([("a", "1", True), ("a", "2", True), ("a", "3", False), ("b", "4", True), ("c", "5", None)], "g string, k string, critical boolean")
    r = spark.createDataFrame([("1", "pass"), ("2", "fail"), ("3", "fail"), ("4", "pending_review"), ("9", None)], "k string, verdict string")
    assert rows(G.critical_gate(s, r, "g", "k")) == {("a", 2, 1, "2", True), ("b", 1, 0, "", False)}
    f = spark.createDataFrame([("a", i, v) for i, v in enumerate(["pass", "fail", "skip", "fail", "fail"])] + [("b", 1, "pass")], "g string, k int, verdict string")
    assert rows(G.failure_summary(f, "g", "k", 2)) == {("a", 5, 4, "1:fail, 2:skip")}
    assert G.failure_summary(f.limit(0), "g", "k").collect() == []


def test_retrieval(spark):
    c = spark.createDataFrame([("a", ["x", "y"], ["q", "y", "y"], []), ("b", [], [], None), ("c", ["x"], None, ["x"]), ("d", ["x"], ["x", "z"], ["z"])], "id string, e array<string>, r array<string>, f array<string>")
    got = {r["id"]: tuple(r)[1:] for r in G.retrieval_scores(c, "id", "e", "r", "f").collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.5, 0, False), "b": (0, 1.0, 1.0, 1.0, 0, True), "c": (0, 0.0, 0.0, 0.0, 0, False), "d": (2, 1.0, 1.0, 0.5, 1, False)}
    s = G.retrieval_summary(G.retrieval_scores(c, "id", "e", "r", "f")).first()
    assert (s["cases"], s["passed"], s["failed"], s["recall"], s["forbidden_rate"], s["passing"]) == (4, 1, 3, 0.625, 0.25, False)
    empty = G.retrieval_summary(G.retrieval_scores(c.limit(0), "id", "e", "r", "f")).first()
    assert (empty["cases"], empty["recall"], empty["forbidden_rate"], empty["passing"]) == (0, 0.0, 0.0, True)


def test_problems_of_corpora_and_results(spark):
    c = spark.createDataFrame([("a", ["x"]), ("a", ["x"]), ("b", []), ("c", ["x", "x"]), (" ", ["x"]), ("d", None), ("e", ["x", " "])], "id string, l array<string>")
    assert rows(G.case_problems(c, "id", ["l"])) == {("a", "id given twice"), ("b", "no l"), ("c", "blank or repeated l"), ("", "blank id"), ("d", "no l"), ("e", "blank or repeated l")}
    r = spark.createDataFrame([("a",), ("b",), ("b",), ("z",), (None,)], "id string")
    assert rows(G.result_problems(c.where("id in ('a', 'b', 'c')"), r, "id")) == {("b", "observed twice"), ("z", "unknown case"), ("c", "no result")}


def test_summaries_and_cases_of_arms(spark):
    r = spark.createDataFrame([("p", "r", 10.0, 5.0), ("p", "r", 12.0, 5.0), ("p", "c", 1.0, 1.0), ("q", "r", 1.0, 1.0), ("q", "c", None, 1.0), ("z", "r", 1.0, 1.0), ("z", "c", 9.0, 1.0), (None, "r", 1.0, None)], "case string, arm string, m double, n double")
    assert rows(G.compare_cases(r, "case", "arm", ["m", "n"], "r", "c"), "case", "state") == {("p", "improved"), ("q", "blocked"), ("z", "blocked"), (None, "blocked")}
    s = {(x["case"], x["metric"]): (x["runs"], x["missing"], x["samples"], x["median"], x["publishable"]) for x in G.run_summary(r.where("arm = 'r'"), ["case"], ["m", "n"], F.col("n").isNotNull()).collect()}
    assert s["p", "m"] == (2, 0, 2, 11.0, True) and s[None, "n"] == (1, 1, 0, None, False)


def test_dispatch_by_trait_methods(spark):
    nodes = spark.createDataFrame([("T", "p::T", "trait"), ("T.go", "p::T::go", "fn"), ("I1", "p::I1", "impl"), ("I1.go", "p::I1::go", "fn"), ("I1.no", "p::I1::no", "fn"), ("I2", "p::I2", "impl"), ("I2.go", "p::I2::go", "fn"), ("S", "p::S", "struct"), ("S.go", "p::S::go", "fn")], "id string, symbol string, kind string")
    edge = lambda i, a, b, kind, rank=1, conf="exact", res="resolved": (i, a, b, kind, rank, 0, res, conf, False)
    data = [edge(1, "T", "T.go", "contains"), edge(2, "I1", "I1.go", "contains"), edge(3, "I1", "I1.no", "contains"), edge(4, "I2", "I2.go", "contains"), edge(5, "S", "S.go", "contains"), edge(6, "I1", "T", "impls-trait"), edge(7, "I2", "T", "impls-trait"), edge(8, "S", "T", "impls-trait")]
    calls = [edge(20, "x", "T.go", "calls", 2), edge(21, "x", "T.go", "calls", 1), edge(22, "x", "T.go", "calls", 2, None), edge(23, "x", "T", "calls", 2), edge(24, "x", "I1.go", "calls", 2)]
    df = spark.createDataFrame(data + calls, "edge_id bigint, from_id string, to_id string, kind string, provenance_rank int, cost int, resolution string, confidence string, bounded boolean")
    assert rows(graph.dispatch_candidates(df, nodes)) == {(20, "T", "go", 2, "I1.go|I2.go")}
    assert rows(graph.dispatch_candidates(df, nodes, most=1)) == {(20, "T", "go", 2, None)}


def test_search_for_many_queries_is_search_for_each(spark):
    nodes = spark.createDataFrame([(f"n{i}#x", s, "f", i) for i, s in enumerate(["a::FooBar", "a::foo_bar", "foobar", "b::c::Foo", "x::ab", "x::A", "FooBarBaz", "ÄÖ::é"])] + [("FOOBAR", None, None, None), ("o", "o", "f", 3)], "id string, symbol string, file string, line_start int")
    queries = ["FooBar", "foobar", "c::Foo", "ab", "a", "n0#x", "zzz", "bar", "b"]
    got = {}
    for r in graph.search_all(nodes, spark.createDataFrame([(q,) for q in queries] + [(None,), ("",)], "query string"), 5).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"], r["score"]))
    for q in queries:
        want = [(i + 1, r["id"], r["score"]) for i, r in enumerate(graph.search(nodes, q, 5).collect())]
        assert sorted(got.get(q, [])) == want, q


def test_status_ladder(spark):
    from ravelin.operators import planning

    reqs = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    specs = spark.createDataFrame([("a", "archived", "fail"), ("a", "active", "pass"), ("b", "active", "pass"), ("b", "active", "pass"), ("c", "active", "pass"), ("c", "active", None), ("d", "staged", None), ("e", "staged", "pass"), (None, "active", "pass")], "id string, tier string, verdict string")
    ready = spark.createDataFrame([("d",), ("f",)], "id string")
    assert rows(planning.status_ladder(reqs, specs, ready)) == {("a", "archived"), ("b", "verified"), ("c", "active"), ("d", "ready"), ("e", "planned"), ("f", "ready"), ("g", "unplanned")}


def test_quality_gate(spark):
    q = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.1)], "doc_id int, overall double")
    d = spark.createDataFrame([(2, "error"), (1, "warning")], "doc_id int, severity string")
    assert rows(G.quality_gate(q, d, 0.6), "doc_id", "n_errors", "passing") == {(1, 0, True), (2, 1, False), (3, 0, False)}
