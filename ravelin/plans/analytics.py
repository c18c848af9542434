"""Queries over verdicts, runs, rankings, requirements and their SQL.

Where the tables hold no contracts, a query shows the operator on rows of the
same shape (orders stand for scenario verdicts, serving runs for test runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions.ids import clean_id, clean_requirement_id, spelling
from ravelin.operators import evaluation as ev
from ravelin.operators import gates, graph, lint
from ravelin.operators import planning as pl
from ravelin.operators import relational as rel
from ravelin.plans import documents
from ravelin.plans.problems import clean
from ravelin.sources import sinks, specs
from ravelin.sources.tables import earliest, table
from ravelin.streaming import journal

PATTERNS = [("crates/*/src/**", "allow"), ("src/**", "allow"), ("**/queue.rs", "deny"), ("vendor/**", "deny")]
LITERALS = ["TODO", "unwrap", "MUST", "otherwise", "fingerprint", "no such text"]


def _verdict(c: str):
    return F.when(F.col(c) == "F", "pass").when(F.col(c) == "O", "skip").otherwise("fail")


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate", "o_orderpriority", _verdict("o_orderstatus").alias("verdict"))


def _runs(spark, d):
    own = ["queue_wait_ms", "service_ms", "response_bytes"]
    pool = ["queued", "active", "outstanding"]
    rows = table(spark, d, "serving_runs").select(clean_id("request_id").alias("request_id"), "arrived_at", "started_at", clean_id("case_id").alias("case_id"), spelling("serving_mode").alias("mode"), "profile", "outcome", "diagnostic", *[F.col(f"measurements.{c}").alias(c) for c in own], *[F.col(f"pool.{c}").alias(c) for c in pool])
    return earliest(rows, "request_id", ["request_id", "started_at", "case_id", "mode", "profile", "outcome", "diagnostic", *own, *pool])


def _nodes(spark, d):
    return graph.current_nodes(table(spark, d, "nodes"), more=["visibility", "doc"])


def first_wins(spark, d):
    orders = _orders(spark, d).select("id", F.lit(0).alias("verifier"), F.col("o_orderkey").alias("seq"), "verdict")
    events = table(spark, d, "events").select(F.col("user_id").alias("id"), F.lit(1).alias("verifier"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("verdict"))
    return rel.first_wins(orders.unionByName(events), "id", ["verifier", "seq"], table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


def coverage(spark, d):
    docs = table(spark, d, "documents").where("doc_kind = 'contract'")
    labels = table(spark, d, "labels")
    results = labels.where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") >= 3, "pass").otherwise("fail").alias("verdict"), F.struct("reviewed_at", "reviewer", "quality").alias("seq"))
    return rel.coverage_matrix(docs, labels, results, "doc_id")


def boundaries(spark, d):
    patterns = spark.createDataFrame(PATTERNS, "pattern string, category string")
    changes = table(spark, d, "nodes").select(F.col("file").alias("path")).unionByName(table(spark, d, "shared_nodes").select(F.col("file").alias("path")))
    return rel.boundary_verdicts(changes, patterns)


def boundary_conflicts(spark, d):
    docs = table(spark, d, "documents").where(F.col("doc_kind") == "contract").select("doc_id", "text")
    return rel.conflicts(specs.boundaries(docs).select("doc_id", F.col("item").alias("text"), "category"))


def checkpoint(spark, d):
    orders = _orders(spark, d)
    early, late = F.col("o_orderdate") < "1995-01-01", F.col("o_orderdate") >= "1995-01-01"
    per = lambda c: orders.where(c).groupBy("id").agg(F.min("verdict").alias("verdict"), F.count("*").alias("duration_ms"))
    return rel.merge_checkpoint(per(late), per(early), "id")


def skips(spark, d):
    units = table(spark, d, "work_units")
    results = units.where(F.col("requirement_id").isNotNull()).select(clean_requirement_id("requirement_id").alias("id"), F.when(F.col("status") == "ready", "pass").otherwise("fail").alias("verdict"))
    needs = units.select(clean_requirement_id("requirement_id").alias("id"), F.explode("depends_on").alias("n")).select("id", clean_requirement_id("n").alias("needs"))
    return rel.dependency_skips(results, needs)


def run_deltas(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rel.deltas(daily, "event_type", ["day"], ["n"])


def latest_runs(spark, d):
    orders = _orders(spark, d).select("id", "o_orderkey", "o_orderdate", "verdict")
    return rel.latest_rows(orders, "id", ["o_orderdate"])


def _budgeted(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", F.octet_length("text").alias("bytes"), "doc_kind", (F.col("doc_kind") == "decision").alias("required"))
    return rel.byte_budget(docs, "source", "doc_id", "bytes", 20_000, "required")


def omission_rollup(spark, d):
    dropped = _budgeted(spark, d).where("NOT kept").select(F.col("doc_kind").alias("class"), F.lit("budget").alias("reason"), F.col("bytes").alias("score"), F.col("doc_id").alias("id"))
    return rel.omissions(dropped)


def page(spark, d):
    nodes = table(spark, d, "nodes").select("symbol", "id").distinct()
    return rel.page_after(nodes, ["symbol", "id"], F.struct(F.lit("m").alias("symbol"), F.lit("").alias("id")), 50)


def candidates(spark, d):
    rows = _nodes(spark, d).select("id", F.when(F.col("visibility") == "pub", 600).otherwise(300).alias("score"), F.col("doc").isNotNull().alias("required"), F.array(F.col("kind"), F.coalesce("visibility", F.lit("none"))).alias("reasons"))
    merged = rel.merge_candidates(rows)
    return merged.withColumn("reasons", F.array_join("reasons", "|"))


def appended(spark, d):
    parts = [table(spark, d, "shared_nodes").select(clean_id("id").alias("id")), table(spark, d, "nodes").select(clean_id("id").alias("id")), table(spark, d, "code_bindings").select(clean_id("node_id").alias("id"))]
    return rel.append_unique(parts, "id")


def first_success(spark, d):
    rows = _runs(spark, d).select("case_id", F.concat(F.date_format("started_at", "yyyyMMddHHmmss.SSSSSS"), "request_id").alias("at"), (F.col("outcome") == "timeout").alias("hit"))
    return rel.first_hit_rank(rows, "case_id", "at", "hit")


def _requirements(spark, d):
    return pl.current_requirements(table(spark, d, "requirements"))


def set_scores(spark, d):
    rows = _requirements(spark, d).select("id", "dependencies", "children")
    return ev.set_scores(rows, "dependencies", "children").drop("dependencies", "children")


def _metrics(spark, d):
    rows = _runs(spark, d).where("service_ms BETWEEN 0 AND 86400000")
    return ev.median_mad(rows, ["profile", "mode"], "service_ms")


def _plan(spark, d):
    return ev.run_plan(table(spark, d, "serving_runs").select(clean_id("case_id").alias("case_id")).where(F.col("case_id").isNotNull()), ["direct", "worker"], 3)


def gaps(spark, d):
    planned = _plan(spark, d).select("case_id", F.col("arm").alias("mode"))
    return ev.plan_gaps(planned, _runs(spark, d).where(F.col("mode").isNotNull()), ["case_id", "mode"])


def ladder(spark, d):
    """Rungs of all requirements; a spec's tier is told by its path, its risk stands for its verdict (A: pass)."""
    specs_ = table(spark, d, "spec_nodes").select(clean_requirement_id("id").alias("spec"), "path", "risk", F.explode("satisfies").alias("_r")).select(clean_requirement_id("_r").alias("id"), "path", "risk")
    tier = F.when(F.col("path").contains("archive/"), "archived").when(F.col("path").contains("roadmap/"), "staged").otherwise("active")
    satisfied = specs_.select("id", tier.alias("tier"), F.when(F.col("risk") == "A", "pass").otherwise("fail").alias("verdict"))
    return pl.status_ladder(_requirements(spark, d), satisfied, pl.work_units(_requirements(spark, d)).where("status = 'ready'"))


def critical(spark, d):
    """Orders stand for scenarios (urgent ones for critical ones), customers for specs."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("spec"), F.col("o_orderkey").alias("scenario"), (F.col("o_orderpriority") == "1-URGENT").alias("critical"), _verdict("o_orderstatus").alias("verdict"))
    return gates.critical_gate(orders, orders.select("scenario", "verdict"), "spec", "scenario")


def failures(spark, d):
    return gates.failure_summary(_orders(spark, d), "id", "o_orderkey")


def quality_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = lint.lint(docs, ["determinism", "testability", "coverage", "explicit-test-binding", "scenario-presence", "bdd-rule-id"])
    return gates.quality_gate(lint.quality(docs, found), found, 0.6)


def _cases(spark, d):
    """Work units as cases of retrieval: what they satisfy is expected, what they depend on was returned, what blocks them is forbidden."""
    ids = lambda c: F.filter(F.transform(c, clean_requirement_id), lambda x: x.isNotNull())
    rows = table(spark, d, "work_units").select(clean_requirement_id("id").alias("id"), "arrived_at", ids("satisfies").alias("expected"), ids("depends_on").alias("ranked"), ids("blocked_by").alias("forbidden"))
    return earliest(rows, "id", ["id", "expected", "ranked", "forbidden"])


def _scores(spark, d):
    return gates.retrieval_scores(_cases(spark, d), "id", "expected", "ranked", "forbidden")


def corpus_problems(spark, d):
    rows = table(spark, d, "work_units").select("id", "satisfies", "depends_on").distinct()
    return gates.case_problems(rows.withColumn("id", F.upper(F.trim("id"))), "id", ["satisfies", "depends_on"])


def result_problems(spark, d):
    """Requirements as the corpus, the work units' requirements as observations."""
    observed = table(spark, d, "work_units").select(clean_requirement_id("id").alias("u"), clean_requirement_id("requirement_id").alias("id")).distinct()
    return gates.result_problems(_requirements(spark, d), observed, "id")


def run_summary(spark, d):
    return gates.run_summary(_runs(spark, d), ["profile", "mode"], ["queue_wait_ms", "service_ms", "response_bytes"], F.col("outcome").isNotNull())


def built_plan(spark, d):
    return pl.plan_edges(_requirements(spark, d), table(spark, d, "work_units"), table(spark, d, "spec_nodes"))


def transition_check(spark, d):
    rows = _requirements(spark, d).select("id", "status", F.explode(F.array(*[F.lit(x) for x in ("proposed", "accepted", "rejected", "deprecated")])).alias("to"))
    return pl.transitions(rows)


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def pending_ack(spark, d):
    """Half of the events are in the snapshot; users with later ones stay in the journal."""
    events = _events(spark, d)
    mid = events.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    snapshot = journal.pending(events.where(F.col("event_id") <= mid), "user_id", "event_id", "ms")
    return journal.acknowledge(journal.pending(events, "user_id", "event_id", "ms"), snapshot, "user_id", mid)


def literals(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rel.pattern_counts(specs.lines(docs), LITERALS)


NAMED = {
    "verdict_counts": lambda spark, d: rel.gate(rel.rollup(rel.verdict_counts(_orders(spark, d), ["o_orderpriority"]))),
    "liveness": lambda spark, d: rel.liveness(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), rel.rollup(rel.verdict_counts(_orders(spark, d), ["id"])), "id"),
    "first_wins_merge": first_wins,
    "coverage_matrix": coverage,
    "boundary_verdicts": boundaries,
    "boundary_conflicts": boundary_conflicts,
    "checkpoint_merge": checkpoint,
    "dependency_skips": skips,
    "run_deltas": run_deltas,
    "latest_run_rows": latest_runs,
    "byte_budget": lambda spark, d: _budgeted(spark, d).select("doc_id", "source", "kept"),
    "omission_rollup": omission_rollup,
    "cursor_page": page,
    "candidate_merge": candidates,
    "append_unique": appended,
    "duplicate_symbols": lambda spark, d: rel.duplicates(_nodes(spark, d).select(F.element_at(F.split("symbol", "::"), -1).alias("name")), "name"),
    "content_fingerprint": lambda spark, d: rel.fingerprint(_nodes(spark, d), ["id", "doc", "line_start"], ["file"]),
    "forbidden_scan": literals,
    "first_hit_rank": first_success,
    "set_scores": set_scores,
    "median_mad": _metrics,
    "lineitem_median_mad": lambda spark, d: ev.median_mad(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"),
    "arm_gate": lambda spark, d: ev.compare_arms(_metrics(spark, d), ["profile"], "mode", "direct", "worker"),
    "arm_cases": lambda spark, d: gates.compare_cases(_runs(spark, d), "profile", "mode", ["queue_wait_ms", "service_ms", "response_bytes"], "direct", "worker"),
    "critical_gate": critical,
    "failure_summary": failures,
    "quality_gate": quality_gate,
    "retrieval_scores": _scores,
    "retrieval_gate": lambda spark, d: gates.retrieval_summary(_scores(spark, d)),
    "corpus_problems": corpus_problems,
    "result_problems": result_problems,
    "run_summary": run_summary,
    "run_problems": lambda spark, d: gates.run_problems(_runs(spark, d)),
    "run_plan": _plan,
    "plan_gaps": gaps,
    "parity": lambda spark, d: ev.parity(_runs(spark, d), "case_id", "mode", "outcome"),
    "requirement_problems": lambda spark, d: pl.graph_problems(_requirements(spark, d)),
    "work_unit_modes": lambda spark, d: pl.work_units(_requirements(spark, d)),
    "spec_coverage": lambda spark, d: pl.spec_coverage(table(spark, d, "spec_nodes")).withColumn("spec_ids", F.array_join("spec_ids", "|")),
    "status_ladder": ladder,
    "plan_edges_built": built_plan,
    "status_transitions": transition_check,
    "pending_journal": lambda spark, d: journal.pending(_events(spark, d), "user_id", "event_id", "ms"),
    "pending_ack": pending_ack,
    "retry_backoff": lambda spark, d: spark.range(0, 8).select(F.col("id").alias("attempt"), T.retry_delay("id").alias("delay_ms")),
    "restricted_paths": lambda spark, d: table(spark, d, "documents").where(F.col("source_path").isNotNull()).select("source_path").distinct().select("source_path", T.restricted_path("source_path").alias("restricted"), T.query_path("source_path").isNotNull().alias("is_path")),
    "mermaid_plan": lambda spark, d: sinks.mermaid_lines(built_plan(spark, d)),
}


def queries() -> dict:
    return dict(NAMED)


_O = "WITH o AS (SELECT o_custkey AS id, o_orderkey, o_orderdate, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'skip' ELSE 'fail' END AS verdict FROM orders)\n"
_COUNTS = "count(*) AS total, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (verdict = 'skip') AS skip, count(*) FILTER (verdict = 'uncertain') AS uncertain"
_ROLL = "CASE WHEN fail > 0 THEN 'fail' WHEN total = 0 OR pass < total THEN 'skip' ELSE 'pass' END"
_R = f"""WITH runs AS (SELECT {clean('request_id')} AS request_id, started_at, {clean('case_id')} AS case_id, regexp_replace(lower({clean('serving_mode')}), '[_\\s-]+', '-', 'g') AS mode, profile, outcome, measurements.service_ms AS service_ms, measurements.queue_wait_ms AS queue_wait_ms, measurements.response_bytes AS response_bytes, diagnostic, pool.queued AS queued, pool.active AS active, pool.outstanding AS outstanding FROM serving_runs WHERE {clean('request_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {clean('request_id')} ORDER BY arrived_at) = 1)
"""
_ids = lambda c: f"list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {clean('x', True)}), lambda x: x IS NOT NULL)))"
_Q = f"""WITH req AS (SELECT * FROM (SELECT {clean('id', True)} AS id, title, status, {_ids('dependencies')} AS dependencies, {_ids('children')} AS children, scenario_count, len(list_filter(coalesce(open_questions, []), lambda q: {clean('q')} IS NOT NULL)) AS n_questions, deleted_at, arrived_at FROM requirements) QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC) = 1),
cur AS (SELECT * FROM req WHERE deleted_at IS NULL),
wu AS (SELECT id, CASE WHEN n_questions > 0 THEN 'blocked_questions' WHEN len(children) > 0 AND coalesce(scenario_count, 0) > 0 THEN 'parent_scenario' WHEN len(children) > 0 THEN 'grouping_only' WHEN coalesce(scenario_count, 0) > 0 THEN 'leaf_full' ELSE 'missing_scenarios' END AS mode, status AS s FROM cur),
modes AS (SELECT id, mode, CASE WHEN s IS DISTINCT FROM 'accepted' THEN 'informational' WHEN mode IN ('leaf_full', 'parent_scenario') THEN 'ready' ELSE 'blocked' END AS status FROM wu),
sat AS (SELECT DISTINCT {clean('id', True)} AS spec, {clean('r', True)} AS requirement_id FROM (SELECT id, unnest(satisfies) AS r FROM spec_nodes) WHERE {clean('r')} IS NOT NULL)
"""
_PLAN = _Q + f", built AS (SELECT id AS from_id, unnest(children) AS to_id, 'child' AS kind FROM cur UNION SELECT unnest(dependencies), id, 'dependency' FROM cur UNION SELECT {clean('requirement_id', True)}, {clean('id', True)}, 'work_unit' FROM work_units WHERE {clean('requirement_id')} IS NOT NULL UNION SELECT spec, requirement_id, 'satisfies' FROM sat WHERE spec IS NOT NULL) "
_B = "WITH docs AS (SELECT doc_id, source, strlen(text) AS bytes, doc_kind, coalesce(doc_kind = 'decision', false) AS required FROM documents WHERE text IS NOT NULL), u AS (SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY required DESC, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM docs), b AS (SELECT *, required OR upto <= 20000 AS kept FROM u) "


def _median(groups: str, source: str, value: str) -> str:
    return f"SELECT {groups}, count(*) AS samples, CAST(median({value}) AS DOUBLE) AS median, CAST(mad({value}) AS DOUBLE) AS mad FROM {source} GROUP BY ALL"


_NOW = f"WITH now AS (SELECT * FROM (SELECT {clean('id')} AS id, symbol, kind, file, line_start, line_end, visibility, doc, deleted_at FROM nodes WHERE {clean('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {clean('id')} ORDER BY arrived_at DESC) = 1) WHERE deleted_at IS NULL) "
_all = lambda c: f"list_filter(list_transform({c}, lambda x: {clean('x', True)}), lambda x: x IS NOT NULL)"
_CASES = f"""WITH c AS (SELECT {clean('id', True)} AS id, coalesce({_all('satisfies')}, []) AS e, coalesce({_all('depends_on')}, []) AS r, coalesce({_all('blocked_by')}, []) AS f FROM work_units WHERE {clean('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {clean('id', True)} ORDER BY arrived_at) = 1),
h AS (SELECT *, len(list_intersect(e, r)) AS hit, len(list_distinct(e)) AS ne, len(list_distinct(r)) AS nr, len(list_intersect(f, r)) AS bad, list_min(list_filter(list_transform(r, lambda x, i: CASE WHEN list_contains(e, x) THEN i END), lambda x: x IS NOT NULL)) AS first FROM c),
sc AS (SELECT id, nr AS n_returned, CASE WHEN ne = 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / ne END AS recall, CASE WHEN ne = 0 THEN 1.0 ELSE coalesce(1.0 / first, 0) END AS reciprocal_rank, CASE WHEN nr = 0 THEN CASE WHEN ne = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(hit AS DOUBLE) / nr END AS precision, bad AS forbidden_hits, hit = ne AND bad = 0 AS passed FROM h)
"""
_LONG = _R + ", m AS (" + " UNION ALL ".join(f"SELECT request_id, profile, mode, outcome, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM runs" for m in ("queue_wait_ms", "service_ms", "response_bytes")) + ")"


def sql() -> dict[str, str]:
    metrics = _median("profile, mode", "runs WHERE service_ms BETWEEN 0 AND 86400000", "CAST(service_ms AS DOUBLE)")
    return {
        "verdict_counts": _O + f"SELECT *, CAST(pass AS DOUBLE) / total AS pass_rate, {_ROLL} AS rollup, total > 0 AND fail = 0 AND skip = 0 AND uncertain = 0 AS passing FROM (SELECT o_orderpriority, {_COUNTS} FROM o GROUP BY 1)",
        "liveness": _O + f", r AS (SELECT id, {_ROLL} AS rollup FROM (SELECT id, {_COUNTS} FROM o GROUP BY 1)) SELECT c_custkey AS id, CASE WHEN rollup = 'fail' THEN 'violated' WHEN rollup = 'pass' THEN 'honored' ELSE 'unproven' END AS liveness FROM customer LEFT JOIN r ON r.id = c_custkey",
        "first_wins_merge": _O + ", e AS (SELECT id, 0 AS v, o_orderkey AS seq, verdict FROM o UNION ALL SELECT user_id, 1, event_id, CASE event_type WHEN 'error' THEN 'fail' ELSE 'pass' END FROM events), f AS (SELECT id, verdict FROM e WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY v, seq, verdict) = 1) SELECT * FROM f UNION ALL SELECT c_custkey, 'skip' FROM customer WHERE c_custkey NOT IN (SELECT id FROM f)",
        "coverage_matrix": "WITH i AS (SELECT DISTINCT doc_id FROM documents WHERE doc_kind = 'contract'), t AS (SELECT DISTINCT doc_id FROM labels), r AS (SELECT doc_id, CASE WHEN quality >= 3 THEN 'pass' ELSE 'fail' END AS verdict FROM labels WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY reviewed_at NULLS FIRST, reviewer NULLS FIRST, quality) = 1) SELECT i.doc_id, CASE WHEN t.doc_id IS NULL THEN 'missing' ELSE 'found' END AS test, verdict FROM i LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id) UNION ALL SELECT doc_id, NULL, verdict FROM r WHERE doc_id NOT IN (SELECT doc_id FROM i)",
        "boundary_verdicts": "SELECT path, CASE WHEN regexp_matches(path, '^(.*/)?queue[.]rs$') OR regexp_matches(path, '^vendor(/.*)?$') THEN 'fail' WHEN regexp_matches(path, '^crates/[^/]*/src(/.*)?$') OR regexp_matches(path, '^src(/.*)?$') THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT file AS path FROM nodes UNION SELECT file FROM shared_nodes) WHERE path IS NOT NULL",
        "boundary_conflicts": documents.BOUNDARIES + "SELECT item AS text, count(DISTINCT doc_id) FILTER (category = 'allow') AS n_allow, count(DISTINCT doc_id) FILTER (category = 'deny') AS n_deny FROM bounds WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_kind = 'contract') GROUP BY 1 HAVING n_allow > 0 AND n_deny > 0",
        "checkpoint_merge": _O + ", a AS (SELECT id, min(verdict) AS old FROM o WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), b AS (SELECT id, min(verdict) AS verdict, count(*) AS n FROM o WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1) SELECT id, CASE WHEN old = 'pass' THEN 'pass' ELSE verdict END AS verdict, CASE WHEN old = 'pass' THEN 0 ELSE n END AS duration_ms, false AS regression FROM b LEFT JOIN a USING (id)",
        "dependency_skips": f"WITH r AS (SELECT {clean('requirement_id', True)} AS id, min(CASE status WHEN 'ready' THEN 'pass' ELSE 'fail' END) AS v FROM work_units WHERE requirement_id IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT id, {clean('n', True)} AS needs FROM (SELECT {clean('requirement_id', True)} AS id, unnest(depends_on) AS n FROM work_units) WHERE {clean('n')} IS NOT NULL), b AS (SELECT DISTINCT n.id FROM n LEFT JOIN r ON r.id = n.needs WHERE coalesce(r.v, 'none') <> 'pass') SELECT id, CASE WHEN id IN (SELECT id FROM b WHERE id IS NOT NULL) THEN 'skip' ELSE v END AS verdict FROM r",
        "run_deltas": "SELECT *, row_number() OVER w AS ordinal, n - lag(n) OVER w AS d_n FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY day)",
        "latest_run_rows": _O + "SELECT id, o_orderkey, o_orderdate, verdict FROM o QUALIFY rank() OVER (PARTITION BY id ORDER BY o_orderdate DESC) = 1",
        "byte_budget": _B + "SELECT doc_id, source, kept FROM b",
        "omission_rollup": _B + "SELECT doc_kind AS class, 'budget' AS reason, count(*) AS n, max(bytes) AS top_score, arg_min(doc_id, (-bytes, doc_id)) AS top_id FROM b WHERE NOT kept GROUP BY 1",
        "cursor_page": "SELECT symbol, id FROM (SELECT DISTINCT symbol, id FROM nodes) WHERE symbol > 'm' OR (symbol = 'm' AND id > '') ORDER BY symbol, id LIMIT 50",
        "candidate_merge": _NOW + "SELECT id, max(CASE visibility WHEN 'pub' THEN 600 ELSE 300 END) AS score, bool_or(doc IS NOT NULL) AS required, list_aggregate(list_sort(list_distinct(flatten(list([kind, coalesce(visibility, 'none')])))), 'string_agg', '|') AS reasons FROM now GROUP BY id",
        "append_unique": f"SELECT id, min(part) AS part FROM (SELECT {clean('id')} AS id, 0 AS part FROM shared_nodes UNION ALL SELECT {clean('id')}, 1 FROM nodes UNION ALL SELECT {clean('node_id')}, 2 FROM code_bindings) WHERE id IS NOT NULL GROUP BY 1",
        "duplicate_symbols": _NOW + "SELECT string_split(symbol, '::')[-1] AS name, count(*) AS n FROM now WHERE symbol IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "content_fingerprint": _NOW + ", h AS (SELECT file, sha256(concat_ws(chr(31), coalesce(id, chr(0)), coalesce(doc, chr(0)), coalesce(CAST(line_start AS VARCHAR), chr(0)))) AS h FROM now), p AS (SELECT file, h[1:3] AS p, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL) SELECT file, sha256(string_agg(p || d, '' ORDER BY p || d)) AS fingerprint FROM p GROUP BY file",
        "forbidden_scan": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in LITERALS) + "]) AS pattern) SELECT pattern, count(doc_id) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM p LEFT JOIN l ON contains(line, pattern) GROUP BY 1",
        "first_hit_rank": _R + ", n AS (SELECT case_id, outcome, row_number() OVER (PARTITION BY case_id ORDER BY started_at, request_id) AS r FROM runs) SELECT case_id, min(r) FILTER (outcome = 'timeout') AS rank, coalesce(1.0 / min(r) FILTER (outcome = 'timeout'), 0) AS reciprocal FROM n GROUP BY 1",
        "set_scores": _Q + ", x AS (SELECT id, len(list_intersect(dependencies, children)) AS h, len(dependencies) AS e, len(children) AS o FROM cur) SELECT id, h AS n_hit, e - h AS n_missing, o - h AS n_extra, CASE WHEN e = 0 THEN 1.0 ELSE CAST(h AS DOUBLE) / e END AS recall, CASE WHEN o = 0 THEN CASE WHEN e = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(h AS DOUBLE) / o END AS precision FROM x",
        "median_mad": _R + metrics,
        "lineitem_median_mad": _median("l_returnflag, l_linestatus", "lineitem", "l_extendedprice"),
        "arm_gate": _R + f", m AS ({metrics}), w AS (SELECT profile, max(median) FILTER (mode = 'direct') AS reference, max(mad) FILTER (mode = 'direct') AS d, max(median) FILTER (mode = 'worker') AS candidate FROM m GROUP BY 1) SELECT profile, reference, candidate, CASE WHEN reference IS NULL OR candidate IS NULL THEN 'incomplete' WHEN candidate < reference - d THEN 'improved' WHEN candidate <= reference + d THEN 'tie' ELSE 'blocked' END AS decision FROM w",
        "arm_cases": _LONG + ", b AS (SELECT profile, mode, metric, median(v) AS md, mad(v) AS d FROM m WHERE v IS NOT NULL AND mode IN ('direct', 'worker') GROUP BY ALL), w AS (SELECT profile, metric, max(md) FILTER (mode = 'direct') AS r, max(d) FILTER (mode = 'direct') AS d, max(md) FILTER (mode = 'worker') AS c FROM b GROUP BY ALL), x AS (SELECT profile, CASE WHEN r IS NULL OR c IS NULL THEN 'incomplete' WHEN c < r - d THEN 'improved' WHEN c <= r + d THEN 'tie' ELSE 'blocked' END AS decision FROM w), n AS (SELECT profile, count(*) FILTER (decision = 'improved') AS n_improved, count(*) FILTER (decision = 'tie') AS n_tie, count(*) FILTER (decision = 'blocked') AS n_blocked, count(*) FILTER (decision = 'incomplete') + 3 - count(*) AS n_incomplete FROM x GROUP BY 1) SELECT *, CASE WHEN n_blocked > 0 OR n_incomplete > 0 THEN 'blocked' WHEN n_improved = 3 THEN 'improved' ELSE 'tie' END AS state FROM n",
        "critical_gate": _O + ", c AS (SELECT id AS spec, o_orderkey AS scenario, verdict <> 'pass' AS bad FROM o WHERE o_orderpriority = '1-URGENT') SELECT spec, count(*) AS n_critical, count(*) FILTER (bad) AS n_blocking, coalesce(array_to_string(list_sort(list_slice(list_sort(list(scenario) FILTER (bad)), 1, 5)), ','), '') AS blocking, count(*) FILTER (bad) > 0 AS blocked FROM c GROUP BY spec",
        "failure_summary": _O + "SELECT id, count(*) AS total, count(*) FILTER (verdict <> 'pass') AS non_passing, array_to_string(list_slice(list(o_orderkey || ':' || verdict ORDER BY o_orderkey, verdict) FILTER (verdict <> 'pass'), 1, 3), ', ') AS first FROM o GROUP BY 1 HAVING non_passing > 0",
        "quality_gate": documents.sql()["quality_score"].replace("SELECT doc_id, CAST(determinism AS DOUBLE)", f", e AS (SELECT doc_id, count(*) AS n FROM ({documents._STRUCTURE} UNION ALL SELECT doc_id, 'bdd-rule-id', 'error', line_no, content FROM rules WHERE rid IS NULL) WHERE severity = 'error' GROUP BY 1) SELECT doc_id, overall, coalesce(e.n, 0) AS n_errors, coalesce(e.n, 0) = 0 AND overall >= 0.6 AS passing FROM (SELECT doc_id, CAST(determinism AS DOUBLE)") + ") LEFT JOIN e USING (doc_id)",
        "retrieval_scores": _CASES + "SELECT * FROM sc",
        "retrieval_gate": _CASES + "SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, avg(recall) AS recall, avg(reciprocal_rank) AS mean_reciprocal_rank, avg(precision) AS precision, CAST(sum(forbidden_hits) AS DOUBLE) / sum(n_returned) AS forbidden_rate, bool_and(passed) AS passing FROM sc",
        "corpus_problems": "WITH u AS (SELECT DISTINCT upper(trim(id)) AS id, satisfies, depends_on FROM (SELECT DISTINCT id, satisfies, depends_on FROM work_units)), v AS (SELECT upper(trim(id)) AS id, satisfies, depends_on FROM (SELECT DISTINCT id, satisfies, depends_on FROM work_units)) SELECT DISTINCT '' AS id, 'blank id' AS problem FROM u WHERE coalesce(id, '') = '' UNION ALL SELECT id, 'id given twice' FROM v WHERE id <> '' GROUP BY 1 HAVING count(*) > 1 UNION ALL " + " UNION ALL ".join(f"SELECT DISTINCT id, CASE WHEN coalesce(len({c}), 0) = 0 THEN 'no {c}' ELSE 'blank or repeated {c}' END FROM u WHERE id <> '' AND (coalesce(len({c}), 0) = 0 OR len(list_filter({c}, lambda x: coalesce(trim(x), '') = '')) > 0 OR len({c}) > len(list_distinct({c})))" for c in ("satisfies", "depends_on")),
        "result_problems": _Q + f", o AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT {clean('id', True)} AS u, {clean('requirement_id', True)} AS id FROM work_units) WHERE id IS NOT NULL GROUP BY 1) SELECT coalesce(cur.id, o.id) AS id, CASE WHEN cur.id IS NULL THEN 'unknown case' WHEN n IS NULL THEN 'no result' ELSE 'observed twice' END AS problem FROM cur FULL JOIN o ON o.id = cur.id WHERE cur.id IS NULL OR n IS NULL OR n > 1",
        "run_summary": _LONG + "SELECT profile, mode, metric, count(*) AS runs, count(*) FILTER (v IS NULL) AS missing, count(v) AS samples, median(v) AS median, mad(v) AS mad, count(*) FILTER (outcome IS NULL) AS n_ungraded, count(*) FILTER (outcome IS NULL) = 0 AS publishable FROM m GROUP BY ALL",
        "run_problems": _R + "SELECT request_id, unnest(list_filter([CASE WHEN mode IS NULL THEN 'no mode' END, CASE WHEN outcome IS NULL THEN 'no outcome' END, CASE WHEN service_ms IS NULL OR queue_wait_ms IS NULL THEN 'not measured' END, CASE WHEN least(queue_wait_ms, service_ms, queued, active, outstanding) < 0 THEN 'negative measurement' END, CASE WHEN outcome = 'success' AND diagnostic IS NOT NULL THEN 'success with diagnostic' END, CASE WHEN outcome <> 'success' AND diagnostic IS NULL THEN 'failure without diagnostic' END, CASE WHEN queued + active <> outstanding THEN 'pool doesn''t add up' END], lambda x: x IS NOT NULL)) AS problem FROM runs",
        "run_plan": f"SELECT case_id, arm, trial, sha256(concat_ws(chr(31), case_id, arm, CAST(trial AS VARCHAR))) AS run_id FROM (SELECT DISTINCT {clean('case_id')} AS case_id FROM serving_runs) CROSS JOIN (SELECT unnest(['direct', 'worker']) AS arm) CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS trial) WHERE case_id IS NOT NULL",
        "plan_gaps": _R + f", p AS (SELECT DISTINCT {clean('case_id')} AS case_id, m AS mode FROM serving_runs, (SELECT unnest(['direct', 'worker']) AS m) WHERE {clean('case_id')} IS NOT NULL), r AS (SELECT case_id, mode, count(*) AS n FROM runs WHERE mode IS NOT NULL GROUP BY ALL) SELECT coalesce(p.case_id, r.case_id) AS case_id, coalesce(p.mode, r.mode) AS mode, CASE WHEN n IS NULL THEN 'missing' WHEN p.case_id IS NULL THEN 'unplanned' ELSE 'duplicate' END AS problem FROM p FULL JOIN r ON p.case_id = r.case_id AND p.mode = r.mode WHERE n IS NULL OR p.case_id IS NULL OR n > 1",
        "parity": _R + "SELECT case_id, count(DISTINCT mode) AS n_modes, count(DISTINCT outcome) AS n_results, count(DISTINCT outcome) = 1 AS equal FROM runs GROUP BY 1",
        "requirement_problems": _Q + "SELECT id, 'dangling dependency' AS problem, x AS other FROM (SELECT id, unnest(dependencies) AS x FROM cur) WHERE x NOT IN (SELECT id FROM cur) UNION ALL SELECT id, 'dangling child', x FROM (SELECT id, unnest(children) AS x FROM cur) WHERE x NOT IN (SELECT id FROM cur) UNION ALL SELECT id, 'leaf without scenario', NULL FROM cur WHERE len(children) = 0 AND coalesce(scenario_count, 0) = 0 UNION ALL SELECT id, 'open questions', NULL FROM cur WHERE n_questions > 0 UNION ALL SELECT x, 'several parents', NULL FROM (SELECT id, unnest(children) AS x FROM cur) GROUP BY x HAVING count(DISTINCT id) > 1",
        "work_unit_modes": _Q + "SELECT * FROM modes",
        "spec_coverage": _Q + "SELECT requirement_id, count(DISTINCT spec) AS n_specs, list_aggregate(list_sort(list(DISTINCT spec)), 'string_agg', '|') AS spec_ids FROM sat WHERE starts_with(requirement_id, 'REQ-') AND spec IS NOT NULL GROUP BY 1",
        "status_ladder": _Q + f", sp AS (SELECT {clean('r', True)} AS id, CASE WHEN contains(path, 'archive/') THEN 'archived' WHEN contains(path, 'roadmap/') THEN 'staged' ELSE 'active' END AS tier, risk FROM (SELECT path, risk, unnest(satisfies) AS r FROM spec_nodes)), t AS (SELECT id, bool_or(tier = 'archived') AS z, bool_or(tier = 'active') AS a, bool_or(tier = 'staged') AS s, bool_and(coalesce(risk, '') = 'A') FILTER (tier = 'active') AS p FROM sp WHERE id IS NOT NULL GROUP BY 1) SELECT cur.id, CASE WHEN z THEN 'archived' WHEN a AND p THEN 'verified' WHEN a THEN 'active' WHEN cur.id IN (SELECT id FROM modes WHERE status = 'ready') THEN 'ready' WHEN s THEN 'planned' ELSE 'unplanned' END AS rung FROM cur LEFT JOIN t ON t.id = cur.id",
        "plan_edges_built": _PLAN + "SELECT * FROM built",
        "status_transitions": _Q + "SELECT id, status, t AS to, (status IS NULL AND t IN ('proposed', 'accepted')) OR (coalesce(status, '') = 'proposed' AND t IN ('accepted', 'rejected')) OR (coalesce(status, '') = 'accepted' AND t = 'deprecated') AS legal FROM cur, (SELECT unnest(['proposed', 'accepted', 'rejected', 'deprecated']) AS t)",
        "pending_journal": "SELECT user_id, min(event_id) AS first_seq, max(event_id) AS latest_seq, epoch_us(min(ts)) // 1000 AS first_seen, epoch_us(max(ts)) // 1000 AS latest_seen FROM events GROUP BY 1",
        "pending_ack": "SELECT user_id, min(event_id) AS first_seq, max(event_id) AS latest_seq, epoch_us(min(ts)) // 1000 AS first_seen, epoch_us(max(ts)) // 1000 AS latest_seen FROM events GROUP BY 1 HAVING max(event_id) > (SELECT max(event_id) // 2 FROM events)",
        "retry_backoff": "SELECT a AS attempt, CASE WHEN a BETWEEN 1 AND 5 THEN CAST(least(30000, 100 * 2 ** (a - 1)) AS BIGINT) END AS delay_ms FROM (SELECT unnest(range(0, 8)) AS a)",
        "restricted_paths": "SELECT DISTINCT source_path, regexp_matches(source_path, '(^|/)(tests?|generated|gen|vendor|vendored|third_party)(/|$)|_(test|generated)[.][^/]*$') AS restricted, contains(source_path, '/') AND NOT starts_with(source_path, '/') AND NOT contains('/' || source_path || '/', '/../') AS is_path FROM documents WHERE source_path IS NOT NULL",
        "mermaid_plan": _PLAN + "SELECT DISTINCT regexp_replace(from_id, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || kind || '| ' || regexp_replace(to_id, '[^A-Za-z0-9_]', '_', 'g') AS line FROM built",
    }
