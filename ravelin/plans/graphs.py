"""Queries over the program graph and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.ids import clean_requirement_id
from ravelin.operators import graph
from ravelin.plans.problems import clean
from ravelin.sources.tables import table

QUERY = "token"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_nodes(table(spark, d, "nodes"), table(spark, d, "shared_nodes"))


def _hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(table(spark, d, "edges"))


def _first_file(nodes: DataFrame) -> DataFrame:
    """The file with the smallest name, standing for a changed file."""
    return nodes.agg(F.min("file").alias("file"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return nodes.join(_first_file(nodes), "file", "left_semi").select("id")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set over the whole graph: every node whose hashed id is divisible by 20."""
    return _nodes(spark, d).where(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("int") % 20 == 0).select("id")


def node_precedence(spark, d):
    return graph.preferred(_hops(spark, d)).groupBy("kind", "provenance_rank").agg(F.count("*").alias("n"))


def search(spark, d):
    return graph.search(_nodes(spark, d), QUERY, 200)


def search_all(spark, d):
    """The last parts of the symbols of the query set, against all nodes."""
    nodes = _nodes(spark, d)
    asked = _asked(spark, d).join(nodes, "id").select(F.element_at(F.split("symbol", "::"), -1).alias("query"))
    return graph.search_all(nodes, asked, 20)


def locate(spark, d):
    values = table(spark, d, "edges").select(F.col("target_text").alias("value"))
    return graph.locate(values, _nodes(spark, d))


def resolve(spark, d):
    return graph.resolve_targets(table(spark, d, "edges"), _nodes(spark, d))


def enclosing(spark, d):
    sites = table(spark, d, "edges").select("edge_id", F.col("site.file").alias("file"), F.col("site.line_start").cast("int").alias("line")).distinct()
    return graph.enclosing(sites, _nodes(spark, d))


def simple_paths(spark, d):
    rows = graph.simple_paths(_hops(spark, d), _seeds(spark, d), 2)
    return graph.bounded_paths(rows, 3).select("start_id", "node_id", "depth", "cost", F.array_join("path", " > ").alias("path"))


def simple_paths_all(spark, d):
    rows = graph.best_two_hops(_hops(spark, d), _asked(spark, d), 3)
    return rows.select("start_id", "node_id", "depth", "cost", F.array_join("path", " > ").alias("path"))


def frontier(spark, d):
    nodes = _nodes(spark, d)
    return graph.change_frontier(_hops(spark, d), nodes, _first_file(nodes))


#: The change that the rebuild frontier answers to: what arrived from here on.
CHANGED = "2026-06-01 00:00:00 UTC"


def rebuild(spark, d):
    before = F.col("arrived_at") < F.expr(f"timestamp '{CHANGED}'")
    nodes, edges = table(spark, d, "nodes"), table(spark, d, "edges")
    # a node that was deleted later was still there before
    old = graph.current_nodes(nodes.where(before).withColumn("deleted_at", F.when(F.col("deleted_at") < F.expr(f"timestamp '{CHANGED}'"), F.col("deleted_at"))))
    return graph.rebuild_frontier(old, graph.current_nodes(nodes), graph.distinct_edges(edges.where(before)), graph.distinct_edges(edges), 10_000)


def requirement_layers(spark, d):
    rows = table(spark, d, "plan_edges").where("kind = 'dependency'")
    return graph.layers(rows.select(clean_requirement_id("from_id").alias("before"), clean_requirement_id("to_id").alias("after")))


def stale(spark, d):
    """Files by a digest of their nodes before and after April 2026."""
    rows = table(spark, d, "nodes").where(F.col("file").isNotNull())
    digest = lambda df: df.groupBy("file").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("id")), ","), 256).alias("hash"))
    return graph.stale_files(digest(rows.where("arrived_at < timestamp '2026-04-01 00:00:00 UTC'")), digest(rows))


NAMED = {
    "graph_current_nodes": lambda spark, d: _nodes(spark, d),
    "graph_hops": lambda spark, d: _hops(spark, d).groupBy("from_id", "to_id", "kind").agg(F.count("*").alias("n"), F.min("cost").cast("int").alias("cost")),
    "graph_precedence": node_precedence,
    "graph_best_hops": lambda spark, d: graph.best_hops(_hops(spark, d)).withColumn("cost", F.col("cost").cast("int")),
    "graph_search": search,
    "graph_search_all": search_all,
    "graph_locate": locate,
    "graph_resolve": resolve,
    "graph_enclosing": enclosing,
    "graph_dispatch": lambda spark, d: graph.dispatch_candidates(_hops(spark, d), _nodes(spark, d)),
    "graph_flow_through": lambda spark, d: graph.flow_pairs(_hops(spark, d), _seeds(spark, d)).withColumn("cost", F.col("cost").cast("int")),
    "graph_simple_paths": simple_paths,
    "graph_impact": lambda spark, d: graph.impact(_hops(spark, d), _seeds(spark, d), 3),
    "graph_references": lambda spark, d: graph.references_of(_hops(spark, d), _seeds(spark, d)),
    "graph_implementations": lambda spark, d: graph.implementations(graph.distinct_edges(table(spark, d, "edges")), _nodes(spark, d)),
    "graph_outline": lambda spark, d: graph.outline(_hops(spark, d), _nodes(spark, d)),
    "graph_change_frontier": frontier,
    "graph_flow_counts": lambda spark, d: graph.flow_counts(_hops(spark, d), _nodes(spark, d)).withColumn("cost", F.col("cost").cast("int")),
    "graph_references_all": lambda spark, d: graph.references_of(_hops(spark, d), _nodes(spark, d)),
    "graph_impact_all": lambda spark, d: graph.impact(_hops(spark, d), _asked(spark, d), 3),
    "graph_simple_paths_all": simple_paths_all,
    "graph_change_frontier_all": lambda spark, d: graph.change_frontiers(_hops(spark, d), _nodes(spark, d)),
    "graph_rebuild_frontier": rebuild,
    "graph_stale_files": stale,
    "graph_layers": requirement_layers,
}


def queries() -> dict:
    return dict(NAMED)


_BASE = f"""WITH allnodes AS (SELECT {clean('id')} AS id, arrived_at, symbol, kind, file, line_start, line_end, deleted_at FROM nodes UNION ALL SELECT {clean('id')}, arrived_at, symbol, kind, file, NULL, NULL, NULL FROM shared_nodes),
live AS (SELECT id, symbol, kind, file, line_start, line_end FROM (SELECT * FROM allnodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC) = 1) WHERE deleted_at IS NULL),
once AS (SELECT edge_id, {clean('from_id')} AS from_id, {clean('to_id')} AS to_id, target_text, resolution, kind, provenance, confidence, candidates, arrived_at FROM edges WHERE edge_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY arrived_at) = 1),
targets AS (SELECT edge_id, to_id AS target FROM once WHERE to_id IS NOT NULL AND (resolution = 'resolved' OR (resolution = 'unresolved' AND coalesce(len(candidates), 0) = 0))
  UNION SELECT edge_id, {clean('x')} FROM (SELECT edge_id, unnest(candidates) AS x FROM once WHERE resolution = 'unresolved') WHERE {clean('x')} IS NOT NULL),
hops AS (SELECT edge_id, from_id, target AS to_id, kind, CASE provenance WHEN 'syn' THEN 1 WHEN 'scip' THEN 2 WHEN 'mir' THEN 3 ELSE 0 END AS provenance_rank,
  CASE WHEN confidence = 'heuristic' THEN 100 WHEN confidence = 'bounded-candidates' THEN 10 WHEN confidence IS NULL AND resolution = 'unresolved' THEN 100 WHEN resolution <> 'resolved' THEN 10 ELSE 0 END AS cost, resolution, confidence, coalesce(len(candidates), 0) > 0 AS bounded FROM once JOIN targets USING (edge_id) WHERE from_id IS NOT NULL),
seeds AS (SELECT id FROM live WHERE file = (SELECT min(file) FROM live))
"""
_REC = "WITH RECURSIVE " + _BASE[5:]
_DEP = "('calls', 'references', 'uses-type', 'impls-trait', 'impl-for')"


#: Seeds of the queries over one file, and of those over the whole graph.
_ONE_FILE = "file = (SELECT min(file) FROM live)"
_ASKED = "CAST('0x' || substr(md5(id), 1, 6) AS INTEGER) % 20 = 0"


def _whole() -> dict[str, str]:
    """SQL of the queries over the whole graph."""
    one = _one_file()
    over = lambda name, seeds: one[name].replace(f"seeds AS (SELECT id FROM live WHERE {_ONE_FILE})", f"seeds AS (SELECT id FROM live WHERE {seeds})")
    seg = lambda x: "list_aggregate(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + x + ", '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), 'string_agg', ' ')"
    bare = lambda x: f"lower(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"
    return {
        "graph_search_all": _BASE + f", q AS (SELECT DISTINCT string_split(symbol, '::')[-1] AS query FROM live WHERE {_ASKED} AND symbol IS NOT NULL), qq AS (SELECT query, {bare('query')} AS b, {seg('query')} AS s FROM q), n AS (SELECT *, {bare('symbol')} AS b, {seg("string_split(symbol, '::')[-1]")} AS s FROM live), m AS (SELECT query, id, symbol, file, line_start, CASE WHEN id = query THEN 600 WHEN symbol = query THEN 500 WHEN lower(id) = lower(query) OR lower(symbol) = lower(query) THEN 400 WHEN ends_with(symbol, '::' || query) THEN 300 WHEN n.s = qq.s THEN 200 WHEN contains(n.b, qq.b) THEN 100 END AS score FROM qq, n WHERE query <> '') SELECT *, row_number() OVER w AS place FROM m WHERE score IS NOT NULL WINDOW w AS (PARTITION BY query ORDER BY score DESC, symbol, file NULLS FIRST, line_start NULLS FIRST, id) QUALIFY row_number() OVER w <= 20",
        "graph_flow_counts": _BASE + "SELECT through, cost, count(*) AS n FROM (SELECT a.from_id, a.to_id AS through, b.to_id, min(a.cost) + min(b.cost) AS cost FROM hops a JOIN hops b ON b.from_id = a.to_id WHERE a.to_id IN (SELECT id FROM live) AND a.from_id <> b.to_id AND a.from_id <> a.to_id AND b.to_id <> a.to_id GROUP BY ALL) GROUP BY ALL",
        "graph_references_all": over("graph_references", "true"),
        "graph_impact_all": over("graph_impact", _ASKED),
        "graph_simple_paths_all": over("graph_simple_paths", _ASKED),
        "graph_change_frontier_all": _BASE + ", f AS (SELECT DISTINCT file FROM live WHERE file IS NOT NULL), n AS (SELECT DISTINCT t.file AS changed, u.file FROM hops JOIN live t ON t.id = to_id JOIN live u ON u.id = from_id WHERE t.file <> u.file), big AS (SELECT changed FROM n GROUP BY 1 HAVING count(*) + 1 > 2048) SELECT * FROM (SELECT file AS changed, file, 'changed' AS reason FROM f UNION ALL SELECT changed, file, 'refers' FROM n) WHERE changed NOT IN (SELECT changed FROM big) UNION ALL SELECT changed, file, 'frontier too large' FROM big, f",
    }


def sql() -> dict[str, str]:
    return _one_file() | _whole()


def _one_file() -> dict[str, str]:
    return {
        "graph_current_nodes": _BASE + "SELECT * FROM live",
        "graph_hops": _BASE + "SELECT from_id, to_id, kind, count(*) AS n, min(cost) AS cost FROM hops GROUP BY ALL",
        "graph_precedence": _BASE + ", m AS (SELECT *, resolution = 'resolved' AND NOT bounded AND kind IN ('calls', 'references') AS judged FROM hops) SELECT kind, provenance_rank, count(*) AS n FROM (SELECT *, max(provenance_rank) FILTER (judged) OVER (PARTITION BY from_id, to_id) AS best FROM m) WHERE NOT judged OR provenance_rank = best GROUP BY ALL",
        "graph_best_hops": _BASE + "SELECT from_id, to_id, kind, cost, edge_id FROM hops QUALIFY row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY cost, provenance_rank DESC, edge_id) = 1",
        "graph_search": _BASE + f""", m AS (SELECT id, symbol, file, line_start, CASE WHEN id = '{QUERY}' THEN 600 WHEN symbol = '{QUERY}' THEN 500 WHEN lower(id) = '{QUERY}' OR lower(symbol) = '{QUERY}' THEN 400 WHEN ends_with(symbol, '::{QUERY}') THEN 300 WHEN lower(string_split(symbol, '::')[-1]) = '{QUERY}' THEN 200 WHEN contains(lower(regexp_replace(symbol, '[^A-Za-z0-9]', '', 'g')), replace('{QUERY}', '_', '')) THEN 100 END AS score FROM live)
SELECT * FROM m WHERE score IS NOT NULL ORDER BY score DESC, symbol, file, line_start NULLS FIRST, id LIMIT 200""",
        "graph_locate": _BASE + ", v AS (SELECT DISTINCT target_text AS value FROM edges WHERE target_text IS NOT NULL), e AS (SELECT DISTINCT value, id FROM v JOIN (SELECT id, id AS value FROM live UNION SELECT id, symbol FROM live) USING (value)), sfx AS (SELECT id, array_to_string(list_slice(p, i, len(p)), '::') AS value FROM (SELECT id, string_split(symbol, '::') AS p, unnest(range(2, len(string_split(symbol, '::')) + 1)) AS i FROM live)) SELECT value, id, true AS exact FROM e UNION ALL SELECT DISTINCT value, id, false FROM v JOIN sfx USING (value) WHERE value NOT IN (SELECT value FROM e)",
        "graph_resolve": _BASE + ", t AS (SELECT DISTINCT target_text FROM edges WHERE target_text IS NOT NULL), a AS (SELECT symbol AS target_text, min(id) AS w FROM live GROUP BY 1 HAVING count(DISTINCT id) = 1), b AS (SELECT string_split(symbol, '::')[-1] AS target_text, min(id) AS l FROM live GROUP BY 1 HAVING count(DISTINCT id) = 1), f AS (SELECT target_text, coalesce(w, CASE WHEN NOT contains(target_text, '::') THEN l END) AS id FROM t LEFT JOIN a USING (target_text) LEFT JOIN b USING (target_text)) SELECT target_text, CASE WHEN id IS NOT NULL THEN 'resolved' WHEN regexp_matches(target_text, '^(std|core|alloc)::') THEN 'external' ELSE 'unresolved' END AS resolution, id FROM f",
        "graph_enclosing": _BASE + ", s AS (SELECT DISTINCT edge_id, site.file AS file, site.line_start AS line FROM edges) SELECT edge_id, arg_min(id, (line_end - line_start, id)) AS node_id FROM s JOIN live USING (file) WHERE kind NOT IN ('crate', 'module') AND line BETWEEN line_start AND line_end GROUP BY edge_id",
        "graph_dispatch": _BASE + ", r AS (SELECT * FROM hops WHERE resolution = 'resolved'), h AS (SELECT DISTINCT from_id AS owner, to_id AS fn_id, string_split(symbol, '::')[-1] AS method FROM r JOIN live ON live.id = to_id WHERE r.kind = 'contains' AND live.kind = 'fn'), t AS (SELECT fn_id, max((owner, method)) AS om FROM h JOIN live ON live.id = owner WHERE live.kind = 'trait' GROUP BY 1), m AS (SELECT DISTINCT r.to_id AS trait_id, method, fn_id FROM r JOIN live ON live.id = r.from_id JOIN h ON h.owner = r.from_id WHERE r.kind = 'impls-trait' AND live.kind = 'impl'), c AS (SELECT trait_id, method, count(*) AS n, string_agg(fn_id, '|' ORDER BY fn_id) AS candidates FROM m GROUP BY ALL), k AS (SELECT edge_id, om[1] AS trait_id, om[2] AS method FROM r JOIN t ON t.fn_id = r.to_id WHERE r.kind = 'calls' AND provenance_rank = 2 AND confidence = 'exact') SELECT edge_id, trait_id, method, n, CASE WHEN n <= 64 THEN candidates END AS candidates FROM k JOIN c USING (trait_id, method)",
        "graph_flow_through": _BASE + "SELECT a.from_id, a.to_id AS through, b.to_id, min(a.cost) + min(b.cost) AS cost FROM hops a JOIN hops b ON b.from_id = a.to_id WHERE a.to_id IN (SELECT id FROM seeds) AND a.from_id <> b.to_id AND a.from_id <> a.to_id AND b.to_id <> a.to_id GROUP BY ALL",
        "graph_simple_paths": _BASE + """, st AS (SELECT from_id, to_id, min(cost) AS cost FROM hops GROUP BY 1, 2), p1 AS (SELECT from_id AS start_id, to_id AS node_id, 1 AS depth, cost, from_id || ' > ' || to_id AS path, concat_ws(chr(31), from_id, to_id) AS sig FROM st WHERE from_id IN (SELECT id FROM seeds) AND from_id <> to_id),
p2 AS (SELECT start_id, s.to_id AS node_id, 2 AS depth, p.cost + s.cost AS cost, path || ' > ' || s.to_id AS path, concat_ws(chr(31), sig, s.to_id) AS sig FROM p1 p JOIN st s ON s.from_id = p.node_id WHERE s.to_id NOT IN (p.start_id, p.node_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY start_id, node_id ORDER BY depth, cost, sig) AS s, row_number() OVER (PARTITION BY start_id, node_id ORDER BY cost, depth, sig) AS c FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)),
q AS (SELECT *, max(CASE WHEN c = 1 AND s <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY start_id, node_id) AS inside FROM r)
SELECT start_id, node_id, depth, cost, path FROM q WHERE s <= CASE inside WHEN 1 THEN 3 ELSE 2 END OR (c = 1 AND inside = 0)""",
        "graph_impact": _REC + f", walk AS (SELECT id, 0 AS distance FROM seeds UNION SELECT CASE WHEN h.kind = 'contains' THEN h.to_id ELSE h.from_id END, w.distance + CASE WHEN h.kind = 'contains' THEN 0 ELSE 1 END FROM walk w JOIN hops h ON (h.kind = 'contains' AND h.from_id = w.id) OR (h.kind IN {_DEP} AND h.to_id = w.id AND w.distance < 3)) SELECT id, min(distance) AS distance FROM walk WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id",
        "graph_references": _BASE + "SELECT DISTINCT from_id, to_id, kind FROM hops WHERE kind IN ('calls', 'references') AND to_id IN (SELECT id FROM seeds)",
        "graph_implementations": _BASE + ", i AS (SELECT * FROM once WHERE kind IN ('impls-trait', 'impl-for')), n AS (SELECT edge_id, resolution, string_split(symbol, '::')[-1] AS name FROM i JOIN live ON live.id = from_id UNION SELECT edge_id, resolution, string_split(symbol, '::')[-1] FROM i JOIN live ON live.id = to_id UNION SELECT edge_id, resolution, string_split(target_text, '::')[-1] FROM i UNION SELECT edge_id, resolution, string_split(to_id, '::')[-1] FROM i) SELECT name, count(*) AS n_edges, count(*) FILTER (resolution <> 'resolved') AS n_open, min(edge_id) AS first_edge FROM n WHERE name IS NOT NULL GROUP BY 1",
        "graph_rebuild_frontier": _BASE + f""", cur AS (SELECT id, symbol, file FROM (SELECT {clean('id')} AS id, symbol, file, deleted_at, arrived_at FROM nodes WHERE {clean('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {clean('id')} ORDER BY arrived_at DESC) = 1) WHERE deleted_at IS NULL),
old AS (SELECT id, symbol, file FROM (SELECT {clean('id')} AS id, symbol, file, deleted_at FROM nodes WHERE {clean('id')} IS NOT NULL AND arrived_at < TIMESTAMPTZ '{CHANGED[:-4]}+00' QUALIFY row_number() OVER (PARTITION BY {clean('id')} ORDER BY arrived_at DESC) = 1) WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMPTZ '{CHANGED[:-4]}+00'),
ch AS (SELECT coalesce(o.id, c.id) AS id, o.symbol AS a, c.symbol AS b, o.file AS fa, c.file AS fb FROM old o FULL JOIN cur c ON c.id = o.id WHERE o.symbol IS DISTINCT FROM c.symbol),
own AS (SELECT DISTINCT f AS file FROM (SELECT fa AS f FROM ch UNION SELECT fb FROM ch) WHERE f IN (SELECT file FROM cur)),
sy AS (SELECT a AS s FROM ch WHERE a IS NOT NULL UNION SELECT b FROM ch WHERE b IS NOT NULL),
e AS (SELECT from_id, to_id, kind, coalesce(target_text, to_id) AS t FROM once WHERE provenance = 'syn' AND kind <> 'contains'),
u AS (SELECT from_id AS id FROM e WHERE to_id IN (SELECT id FROM ch) OR t IN (SELECT s FROM sy) OR (NOT contains(t, '::') AND t IN (SELECT string_split(s, '::')[-1] FROM sy)) OR (kind IN ('impls-trait', 'impl-for') AND EXISTS (SELECT 1 FROM once WHERE kind IN ('impls-trait', 'impl-for') AND arrived_at >= TIMESTAMPTZ '{CHANGED[:-4]}+00')))
SELECT file, 'changed' AS reason FROM own UNION ALL SELECT DISTINCT file, 'depends' FROM cur WHERE id IN (SELECT id FROM u) AND file IS NOT NULL AND file NOT IN (SELECT file FROM own)""",
        "graph_outline": _BASE + ", k AS (SELECT from_id, to_id FROM hops WHERE kind = 'contains' AND from_id <> to_id) SELECT id, (SELECT min(from_id) FROM k WHERE to_id = id) AS parent, (SELECT count(DISTINCT to_id) FROM k WHERE from_id = id) AS n_children FROM live",
        "graph_change_frontier": _BASE + ", n AS (SELECT DISTINCT file FROM live WHERE id IN (SELECT from_id FROM hops WHERE to_id IN (SELECT id FROM seeds))) SELECT min(file) AS file, 'changed' AS reason FROM live UNION ALL SELECT file, 'refers' FROM n WHERE file <> (SELECT min(file) FROM live)",
        "graph_stale_files": "WITH a AS (SELECT file, list_sort(list(DISTINCT id)) AS h FROM nodes WHERE file IS NOT NULL AND arrived_at < TIMESTAMPTZ '2026-04-01 00:00:00+00' GROUP BY 1), b AS (SELECT file, list_sort(list(DISTINCT id)) AS h FROM nodes WHERE file IS NOT NULL GROUP BY 1) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.file = b.file WHERE a.h IS DISTINCT FROM b.h",
        "graph_layers": f"WITH RECURSIVE l AS (SELECT DISTINCT {clean('from_id', True)} AS a, {clean('to_id', True)} AS b FROM plan_edges WHERE kind = 'dependency' AND {clean('from_id')} IS NOT NULL AND {clean('to_id')} IS NOT NULL), n AS (SELECT a AS node FROM l UNION SELECT b FROM l), reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b), bad AS (SELECT a AS node FROM reach WHERE a = b), behind AS (SELECT node FROM bad UNION SELECT b FROM reach WHERE a IN (SELECT node FROM bad)), walk AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT b FROM l) UNION SELECT l.b, w.layer + 1 FROM walk w JOIN l ON l.a = w.node WHERE l.b NOT IN (SELECT node FROM behind)) SELECT node, max(layer) AS layer FROM walk GROUP BY node",
    }
