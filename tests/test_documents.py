from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import lint
from ravelin.sources import specs

SPEC = '''spec: task
name: "demo"
tags: [a, b]
satisfies: [req-x-1]
---

## Intent
Handle the thing quickly.

## Constraints
### Must
- Respond fast
### Must not
- Use `unwrap`

## Decisions
- Sort by id
- Something unrelated entirely

## Boundaries
### Allowed Changes
- src/**
### Forbidden
- src/secret.rs

## Completion Criteria
Rule: good-rule — A rule
Scenario: first one
  Test: t_first
  Given a "value" of 3
  When it might run with "other"
  Then ids are sorted
Rule: Bad Rule
Scenario: 第二
  当 什么都没有
<!-- lint-ack: unquantified — fine -->
'''


def docs(spark):
    return spark.createDataFrame([(1, SPEC), (2, None), (3, ""), (4, "no spec at all\n\nScenario:\n")], "doc_id int, text string")


def test_tables_of_a_document(spark):
    d = docs(spark)
    m = specs.spec_meta(d).first()
    assert (m["level"], m["name"], m["tags"], m["satisfies"]) == ("task", "demo", ["a", "b"], ["REQ-X-1"])
    assert [(r["category"], r["item"]) for r in specs.constraints(d).orderBy("line_no").collect()] == [("must", "Respond fast"), ("must_not", "Use `unwrap`")]
    assert [(r["category"], r["item"]) for r in specs.boundaries(d).orderBy("line_no").collect()] == [("allow", "src/**"), ("deny", "src/secret.rs")]
    s = {r["scenario"]: r for r in specs.scenarios(d).collect()}
    assert (s["first one"]["selector"], s["first one"]["n_steps"], s["first one"]["rule"]) == ("t_first", 3, "good-rule")
    assert (s["第二"]["selector"], s["第二"]["n_steps"], s["第二"]["rule"]) == (None, 1, None)
    assert [(r["kind"], r["params"]) for r in specs.steps(d).where("scenario_no = 1").orderBy("step_no").collect() if r["params"] or r["kind"] == "then"][:2] == [("given", ["value"]), ("when", ["other"])]
    assert [tuple(r) for r in specs.lint_acks(d).collect()] == [(1, "unquantified", "fine")]


def test_rules(spark):
    found = {(r["rule"], r["detail"]) for r in lint.lint(docs(spark)).where("doc_id = 1").collect()}
    for expected in [("vague-verb", "handle"), ("unquantified", "fast"), ("determinism", "might"), ("implicit-dep", "other"), ("explicit-test-binding", "第二"), ("bdd-rule-id", "Bad Rule"), ("decision-coverage", "Something unrelated entirely"), ("error-path", "no error scenario")]:
        assert expected in found, expected
    split = lint.split_acknowledged(lint.lint(docs(spark), ["unquantified", "explicit-test-binding"]), specs.lint_acks(docs(spark)))
    assert {(r["rule"], r["acknowledged"]) for r in split.where("doc_id = 1").collect()} == {("unquantified", True), ("explicit-test-binding", False)}
    assert lint.lint(docs(spark).limit(0)).collect() == []


def test_quality_and_dimensions(spark):
    q = {r["doc_id"]: r for r in lint.quality(docs(spark), lint.lint(docs(spark))).collect()}
    assert q[1]["determinism"] == 0.5 and q[3]["determinism"] == 0.0 and q[3]["coverage"] == 1.0
    assert {r["dimension"] for r in lint.dimension_counts(lint.lint(docs(spark).limit(0))).collect()} == set(lint.ALL_DIMENSIONS)


def test_scalar_functions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(T.identifier_segments(F.lit("HTTPServer2_fooBar"))) == ["http", "server", "2", "foo", "bar"]
    assert one(T.normative(F.lit("x SHOULD NOT y MUST"))) == "should_not" and one(T.normative(F.lit("none"))) is None
    assert one(T.normative_count(F.lit("MUST SHALL MUSTARD"))) == 2
    assert one(T.step_kind(F.lit(" GIVEN x"))) == "given" and one(T.step_kind(F.lit("givenx"))) is None
    assert one(T.truncated(F.lit("abcdefgh"), 6)) == "abc..." and one(T.slug(F.lit(" A b--C "), "test_")) == "test_a_b_c"
    assert one(T.rule_id(F.lit("good-id — Name"))) == "good-id" and one(T.rule_id(F.lit("Bad Id"))) is None
    assert [one(T.retry_delay(F.lit(a))) for a in (0, 1, 5, 6)] == [None, 100, 1600, None]
    assert one(T.summary_counts(F.lit("3/5 passed, 1 failed, 1 skipped"))).asDict() == {"passed": 3, "total": 5, "failed": 1, "skipped": 1}
    assert one(T.summary_counts(F.lit("3/5 passed"))) is None
    assert one(T.query_path(F.lit("../a/b"))) is None and one(T.query_path(F.lit("./a/b.rs"))) == "a/b.rs"
    globs = [("a/**", "a", True), ("a/**", "a/b/c", True), ("**/x.rs", "x.rs", True), ("a/*/c", "a/b/d/c", False), ("a.b", "axb", False), ("**", "p/q", True)]
    for pattern, path, want in globs:
        assert one(F.rlike(F.lit(path), T.path_glob(F.lit(pattern)))) is want, (pattern, path)
    assert one(F.rlike(F.lit("a/b"), T.text_glob(F.lit("a*")))) is False and one(F.rlike(F.lit("a/b"), T.text_glob(F.lit("a**")))) is True
    assert one(T.prefix_glob("src/**", F.lit("src/a"))) and not one(T.prefix_glob("src", F.lit("src/a")))


def test_numstat_and_test_functions(spark):
    d = spark.createDataFrame([(1, "3\t1\ta.rs\n-\t-\tb.png\n2\t0\tc.rs"), (2, "#[test]\nfn one() {}\nfn two() {}\n#[tokio::test]\nasync fn three() {}")], "doc_id int, text string")
    assert {tuple(r) for r in specs.numstat(d).collect()} == {(1, 5, 1)}
    assert {r["name"] for r in specs.test_functions(d).collect()} == {"one", "three"}
