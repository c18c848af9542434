from pyspark.sql import functions as F

from ravelin.operators import evaluation as E
from ravelin.operators import relational as R


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_unique_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, x int")
    right = spark.createDataFrame([("a", "i"), ("a", "i"), ("b", "i"), ("b", "j"), (None, "n")], "k string, v string")
    assert rows(R.unique_join(left, right, "k", "v"), "k", "v") == {("a", "i"), ("b", None), ("c", None), (None, None)}


def test_first_wins_with_ties_and_missing(spark):
    results = spark.createDataFrame([("a", 1, 5, "fail"), ("a", 0, 9, "skip"), ("a", 0, 9, "pass"), (None, 0, 0, "pass")], "id string, verifier int, seq int, verdict string")
    every = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    assert rows(R.first_wins(results, "id", ["verifier", "seq"], every), "id", "verdict") == {("a", "pass"), ("b", "skip")}


def test_boundaries(spark):
    paths = spark.createDataFrame([("a",), ("a/b/c.rs",), ("a/x.rs",), ("q.rs",), (None,), ("a/x/y.rs",)], "path string")
    p = lambda *x: spark.createDataFrame(list(x), "pattern string, category string")
    assert rows(R.boundary_verdicts(paths, p(("a/**", "allow"), ("a/*.rs", "deny"))), "path", "verdict") == {("a", "pass"), ("a/b/c.rs", "pass"), ("a/x.rs", "fail"), ("q.rs", "fail"), ("a/x/y.rs", "pass")}
    assert rows(R.boundary_verdicts(paths, p(("**/y.rs", "general"))), "path", "verdict") == {("a", "pass"), ("a/b/c.rs", "pass"), ("a/x.rs", "pass"), ("q.rs", "pass"), ("a/x/y.rs", "fail")}
    assert R.boundary_verdicts(paths, spark.createDataFrame([], "pattern string, category string")).collect() == []


def test_checkpoint_and_skips(spark):
    now = spark.createDataFrame([("a", "fail", 5), ("b", "fail", 6), ("c", "pass", 7)], "id string, verdict string, duration_ms bigint")
    old = spark.createDataFrame([("a", "pass"), ("b", "fail")], "id string, verdict string")
    assert rows(R.merge_checkpoint(now, old, "id"), "id", "verdict", "duration_ms") == {("a", "pass", 0), ("b", "fail", 6), ("c", "pass", 7)}
    assert rows(R.merge_checkpoint(now, old, "id", False), "id", "verdict", "regression") == {("a", "fail", True), ("b", "fail", False), ("c", "pass", False)}
    results = spark.createDataFrame([("a", "fail"), ("b", "pass"), ("c", "pass"), ("d", "pass")], "id string, verdict string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "zz"), ("d", None)], "id string, needs string")
    assert rows(R.dependency_skips(results, needs), "id", "verdict") == {("a", "fail"), ("b", "skip"), ("c", "pass"), ("d", "skip")}


def test_counts_rollup_gate_liveness(spark):
    r = spark.createDataFrame([("a", "pass"), ("a", "pass"), ("b", "pass"), ("b", "skip"), ("c", "fail"), ("d", "other")], "id string, verdict string")
    counts = R.gate(R.rollup(R.verdict_counts(r, ["id"])))
    assert rows(counts, "id", "rollup", "passing", "pass_rate") == {("a", "pass", True, 1.0), ("b", "skip", False, 0.5), ("c", "fail", False, 0.0), ("d", "skip", True, 0.0)}
    assert rows(R.gate(R.verdict_counts(r, ["id"]), strict=True).where("id = 'd'"), "passing") == {(False,)}
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",), (None,)], "id string")
    assert rows(R.liveness(items, R.rollup(R.verdict_counts(r, ["id"])), "id"), "id", "liveness") == {("a", "honored"), ("b", "unproven"), ("c", "violated"), ("zz", "unproven")}
    empty = R.verdict_counts(r.limit(0), [])
    assert rows(R.gate(R.rollup(empty)), "total", "pass_rate", "rollup", "passing") == {(0, 0.0, "skip", False)}


def test_byte_budget_equals_plain_prefix_sum(spark):
    import random

    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), i, rng.randrange(1, 60), rng.random() < 0.05) for i in range(800)]
    df = spark.createDataFrame(data, "g string, o int, n int, must boolean")
    got = {r["o"]: r["kept"] for r in R.byte_budget(df, "g", "o", "n", 900, "must").collect()}
    for g in ("a", "b", None):
        own = sorted((d for d in data if d[0] == g), key=lambda d: d[1])
        used = sum(d[2] for d in own if d[3])
        for d in own:
            if not d[3]:
                used += d[2]
            assert got[d[1]] == (d[3] or used <= 900)


def test_paging_duplicates_fingerprint(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3), ("b", 1)], "s string, i int")
    page = R.page_after(df, ["s", "i"], F.struct(F.lit("b").alias("s"), F.lit(1).alias("i")), 2)
    assert [tuple(r) for r in page.collect()] == [("b", 2), ("c", 3)]
    assert rows(R.duplicates(df, "s"), "s", "n") == {("b", 2)}
    assert R.fingerprint(df, ["s", "i"]).collect() == R.fingerprint(df.repartition(3), ["s", "i"]).collect()
    one = spark.createDataFrame([(None,), ("",)], "s string")
    assert len({R.fingerprint(one.where(c), ["s"]).first()[0] for c in ("s IS NULL", "s = ''")}) == 2


def test_empty_group_rules(spark):
    r = spark.range(1).select(E.ratio(F.lit(0), F.lit(0)).alias("a"), E.precision(F.lit(0), F.lit(0), F.lit(True)).alias("b"), E.precision(F.lit(0), F.lit(0), F.lit(False)).alias("c")).first()
    assert tuple(r) == (1.0, 1.0, 0.0)
    assert spark.range(0).agg(E.mean("id").alias("m")).first()["m"] == 0.0


def test_median_mad_and_arms(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 4.0, 100.0)] + [("y", 5.0), ("y", None), (None, 2.0)], "g string, v double")
    assert rows(E.median_mad(df, ["g"], "v"), "g", "samples", "median", "mad") == {("x", 4, 3.0, 1.5), ("y", 1, 5.0, 0.0), (None, 1, 2.0, 0.0)}
    s = spark.createDataFrame([("p", "r", 10.0, 2.0), ("p", "c", 7.0, 0.0), ("q", "r", 10.0, 2.0), ("q", "c", 12.0, 0.0), ("z", "r", 1.0, 0.0)], "k string, arm string, median double, mad double")
    assert rows(E.compare_arms(s, ["k"], "arm", "r", "c"), "k", "decision") == {("p", "improved"), ("q", "tie"), ("z", "incomplete")}


def test_first_hit_rank(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("c", 1, True)], "c string, o int, hit boolean")
    assert rows(R.first_hit_rank(df, "c", "o", "hit"), "c", "rank", "reciprocal") == {("a", 2, 0.5), ("b", None, 0.0), ("c", 1, 1.0)}
