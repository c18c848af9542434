"""Rules without a case in the tables, on documents made by hand: the SQL of the whole report says the same."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ravelin.operators import lint
from ravelin.plans import documents
from ravelin.sources import specs

HEAD = 'spec: {level}\nname: "x"\n---\n\n'
CASES = {
    "vague-verb": (HEAD.format(level="task") + "## Intent\nWe Handle it\n\n## Constraints\n- must manage ids\nhandle, but no item\n\n## Completion Criteria\nScenario: a fails\n  Test: t\n  When x\n  Then manage y\n", {("vague-verb", "info"), ("vague-verb", "warning")}),
    "unquantified": (HEAD.format(level="task") + "## Constraints\n- a fast id\n\n## Decisions\n- a fast plan id\n\n## Completion Criteria\nScenario: id error\n  Test: t\n  When id\n  Then plan\n", {("unquantified", "warning")}),
    "testability": (HEAD.format(level="task") + "## Completion Criteria\nScenario: error\n  Test: t\n  Given nice\n  When x\n  Then it is 直观\n", {("testability", "warning")}),
    "sycophancy": (HEAD.format(level="task") + "## Intent\nPlease find all bugs\n\n## Completion Criteria\nScenario: error\n  Test: t\n  When x\n  Then 找出所有\n", {("sycophancy", "warning")}),
    "universal": (HEAD.format(level="task") + "## Decisions\n- all callers get one error\n\n## Completion Criteria\nScenario: error\n  Test: t\n  When callers\n  Then x\n", {("universal-claim", "warning")}),
    "universal, two scenarios": (HEAD.format(level="task") + "## Decisions\n- all callers get one error\n\n## Completion Criteria\nScenario: error\n  Test: t\n  When callers\n  Then x\nScenario: b\n  Test: u\n  When x\n  Then y\n", set()),
    "universal, not a task": (HEAD.format(level="project") + "## Decisions\n- all callers get one error\n", set()),
    "coverage": (HEAD.format(level="task") + "## Constraints\n- keep ledger\n- with the\n\n## Completion Criteria\nScenario: ledger error\n  Test: t\n  When x\n  Then y\n", {("coverage", "warning")}),
    "observable": (HEAD.format(level="task") + "## Decisions\n- `cache` lives 5 minutes\n\n## Completion Criteria\nScenario: error\n  Test: t\n  When x\n  Then y\n", {("decision-coverage", "warning"), ("observable-decision-coverage", "warning")}),
    "output modes": (HEAD.format(level="task") + "## Intent\nadds --json and stderr\n\n## Completion Criteria\nScenario: json error\n  Test: t\n  When x\n  Then y\n", {("output-mode-coverage", "warning")}),
    "order": (HEAD.format(level="task") + "## Decisions\n- flag -> file -> default\n- prefer ledger over journal\n\n## Completion Criteria\nScenario: flag error\n  Test: t\n  When ledger\n  Then y\n", {("precedence-fallback-coverage", "warning")}),
    "io": (HEAD.format(level="task") + "## Completion Criteria\nScenario: network error\n  Test: t\n  When a mock fails\n  Then y\nScenario: disk error\n  Test: t\n  Level: unit\n  Targets: disk\n  When a closure in a temp dir\n  Then y\n", {("external-io-error-strength", "warning"), ("verification-metadata-suggestion", "warning")}),
    "entry points": (HEAD.format(level="task") + "## Boundaries\n### Allowed Changes\n- src/bin/one.rs\n- src/main.rs\n- src/x.rs\n### Forbidden\n- src/bin/three.rs\n\n## Completion Criteria\nScenario: main error\n  Test: t\n  When x\n  Then y\n", {("boundary-entry-point", "warning")}),
    "flags": (HEAD.format(level="task") + "## Constraints\n- supports --full and --json\n\n## Completion Criteria\nScenario: error of --full\n  Test: t\n  When supports\n  Then y\nScenario: --json\n  Test: t\n  When x\n  Then y\n", {("flag-combination-coverage", "warning"), ("vague-verb", "warning")}),
    "platform": (HEAD.format(level="task") + "## Decisions\n- call npm\n- call pip [python-only]\n\n## Completion Criteria\nScenario: call error\n  Test: t\n  When x\n  Then y\n", {("platform-decision-tag", "info"), ("output-mode-coverage", "warning")}),
    "circular": (HEAD.format(level="task") + "## Completion Criteria\nScenario: a error\n  Test: t\n  Depends: b, c\n  When x\n  Then y\nScenario: b\n  Test: t\n  Depends: a error\n  When x\n  Then y\n", {("circular-dependency", "error")}),
    "rules": (HEAD.format(level="task") + "## Completion Criteria\nRule: Bad Id\nRule: kept-id — name\nScenario: a error\n  Test: t\n  When x\n  Then y\nRule: empty-id\n## Out of Scope\n- x\n", {("bdd-rule-id", "error"), ("bdd-rule-grouping", "warning")}),
    "loose scenarios": (HEAD.format(level="task") + "## Completion Criteria\n" + "Scenario: {0} error\n  Test: t\n  When x\n  Then y\n" * 3, {("bdd-rule-grouping", "info")}),
    "no criteria": (HEAD.format(level="task") + "## Intent\nx\n", {("scenario-presence", "error")}),
    "unbound and shapeless": (HEAD.format(level="task") + "## Completion Criteria\nScenario: a\n  And 点击 it\n  Then \"p\"\n", {("explicit-test-binding", "error"), ("error-path", "warning"), ("bdd-scenario-shape", "warning"), ("bdd-implementation-detail", "info"), ("implicit-dep", "warning")}),
    "nothing": ("", set()),
    "null": (None, set()),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES.values())], "doc_id bigint, text string")
    return {tuple(r) for r in lint.lint(docs).collect()}


def test_each_rule_has_its_case(found):
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert {(r[1], r[2]) for r in found if r[0] == i} == want, name


def test_sql_says_the_same(found):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, (t, _) in enumerate(CASES.values())])
    counted = {}
    for r in found:
        counted[r[1], r[2]] = counted.get((r[1], r[2]), 0) + 1
    assert {(a, b): n for a, b, n in con.execute(documents.sql()["lint_report"]).fetchall()} == counted


def test_contradictions_are_counted(spark):
    text = HEAD.format(level="task") + "## Decisions\n- enable ledger\n- use journal\n"
    docs = spark.createDataFrame([(1, text), (2, "## Decisions\n- disable ledger now\n- do not use journal\n"), (3, None)], "doc_id bigint, text string")
    got = {(r["positive"], r["word"]): (r["n_allow"], r["n_deny"], r["allow_doc"], r["deny_doc"]) for r in lint.decision_contradictions(specs.parsed(docs)).collect()}
    assert got == {("enable ", "ledger"): (1, 1, 1, 2), ("use ", "journal"): (2, 1, 1, 2)}
    assert lint.decision_contradictions(docs.limit(0)).collect() == []


def test_selector_fields(spark):
    docs = spark.createDataFrame([(1, "## Completion Criteria\nScenario: a\n  Test: t\n  包：core\n  Test Double: stub\n  Level: unit\n  Level: e2e\n  When x\n")], "doc_id bigint, text string")
    assert [tuple(r) for r in specs.selector_fields(docs).select("package", "filter", "level", "test_double", "targets").collect()] == [("core", None, "e2e", "stub", None)]
    assert specs.parsed(docs).select(F.max("n_scenarios")).first()[0] == 1
