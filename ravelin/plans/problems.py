"""Queries p1 to p5 (general problems) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.ids import clean_id, clean_requirement_id
from ravelin.operators import circles, eager, hierarchy, quantiles, references, serving, shred
from ravelin.session import cut, scratch_table
from ravelin.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.heavy_nodes(table(spark, d, "edges"))


def p1_degrees(spark: SparkSession, d: str) -> DataFrame:
    return eager.degrees_by_kind(table(spark, d, "edges"))


def p1_through(spark: SparkSession, d: str) -> DataFrame:
    return eager.node_degrees(table(spark, d, "edges"))


def p1_file_traffic(spark: SparkSession, d: str) -> DataFrame:
    columns = ["id", "file"]
    nodes = table(spark, d, "nodes").select(columns).unionByName(table(spark, d, "shared_nodes").select(columns))
    return eager.file_traffic(table(spark, d, "edges"), nodes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.objects(shred.shred(table(spark, d, "receipt_records"), markers=True)).select("record_id", "node_path").distinct()


def _flat(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shred.flat_table(shred.shred(table(spark, d, "receipt_records")), name)

    return query


def _values(name: str):
    return lambda spark, d: shred.value_list(shred.shred(table(spark, d, "receipt_records")), name)


def _serving(period: str, bits: int | None = None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return serving.percentiles_per(table(spark, d, "serving_runs"), period, bits)

    return query


def p3_monthly_stored(spark: SparkSession, d: str) -> DataFrame:
    """:func:`p3_monthly` from a stored table to which two parts of the runs (by request) are added one after the other."""
    runs, path = table(spark, d, "serving_runs"), scratch_table(spark, "serving")
    part = F.pmod(F.xxhash64(clean_id("request_id")), F.lit(2))
    for i in (0, 1):
        quantiles.store(serving.daily_states(runs.where(part == i)), path, str(i))
    return serving.percentiles_of(quantiles.stored(spark, path, ["serving_mode", "day", "metric"]), "month")


#: Rows that arrive from here on are the second delivery of p4_keys.
SECOND = "2026-04-01 00:00:00 UTC"


def _reference_inputs(spark: SparkSession, d: str, which=lambda df: df) -> tuple[DataFrame, DataFrame]:
    refs = references.all_references(*(which(table(spark, d, t)) for t in ("work_units", "spec_nodes", "code_bindings")))
    return refs, references.all_existence(*(which(table(spark, d, t)) for t in ("requirements", "nodes", "shared_nodes")))


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Missing keys and how often each is named per month, from a stored state to which a second delivery is added."""
    late = F.coalesce(F.col("arrived_at") >= F.expr(f"timestamp '{SECOND}'"), F.lit(True))
    refs, deltas = _reference_inputs(spark, d, lambda df: df.where(~late))
    state, known = cut(references.reference_state(refs, deltas)), cut(refs)
    state, _ = references.maintained(state, known, *_reference_inputs(spark, d, lambda df: df.where(late)))
    return references.report(state).where(F.col("there") <= 0).select("target", "ref_id", "period", "n_refs")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(*_reference_inputs(spark, d)).select("src_table", "src_id", "field", "ref_id", "period").distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(*_reference_inputs(spark, d))


def prerequisite_links(work_units: DataFrame) -> DataFrame:
    """(a, b): a work unit's requirement and each prerequisite it names."""
    rows = work_units.select(clean_requirement_id("requirement_id").alias("a"), F.explode("depends_on").alias("_b"))
    return rows.select("a", clean_requirement_id("_b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    child = hierarchy.tree_positions(table(spark, d, "plan_edges"))
    loops = circles.components(prerequisite_links(table(spark, d, "work_units")))
    child = child.select(F.lit("child").alias("relation"), "node_id", "root_id", "depth")
    return child.unionByName(loops.select(F.lit("depends_on").alias("relation"), F.col("node").alias("node_id"), "root_id", F.lit(-1).alias("depth")))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, root, depth and preorder number of every requirement of a tree."""
    return hierarchy.tree_paths(table(spark, d, "plan_edges"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of every requirement as an interval of preorder numbers within its root's tree."""
    return hierarchy.tree_intervals(table(spark, d, "plan_edges"))


def queries() -> dict:
    out = {"p1_found": p1_found, "p1_degrees": p1_degrees, "p1_through": p1_through, "p1_file_traffic": p1_file_traffic, "p2_found": p2_found}
    out |= {f"p2_{name}": _flat(name) for name in shred.TABLES}
    out |= {f"p2_{name}": _values(name) for name in shred.VALUE_LISTS}
    out |= {"p3_daily": _serving("day"), "p3_weekly": _serving("week"), "p3_monthly": _serving("month"), "p3_monthly_bounded": _serving("month", 8), "p3_monthly_stored": p3_monthly_stored}
    out |= {"p4_found": p4_found, "p4_counts": p4_counts, "p4_keys": p4_keys, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}
    return out


_CLEAN = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"


def clean(c: str, upper: bool = False) -> str:
    text = _CLEAN.format(c)
    return f"upper({text})" if upper else text


_EDGES = f"""WITH once AS (SELECT * FROM edges WHERE edge_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY arrived_at) = 1),
entries AS (
  SELECT edge_id, kind, 'outgoing' AS direction, {clean('from_id')} AS node_id FROM once
  UNION ALL SELECT edge_id, kind, 'incoming', {clean('to_id')} FROM once WHERE resolution = 'resolved' OR (resolution = 'unresolved' AND coalesce(len(candidates), 0) = 0)
  UNION ALL SELECT DISTINCT edge_id, kind, 'incoming', {clean('c')} FROM (SELECT edge_id, kind, unnest(candidates) AS c FROM once WHERE resolution = 'unresolved')
)
"""

_MODE = r"regexp_replace(lower(" + clean("serving_mode") + r"), '[_\s-]+', '-', 'g')"


def _serving_sql(period: str, bits: int | None = None) -> str:
    start = "CAST(started_at AT TIME ZONE 'UTC' AS DATE)" if period == "day" else f"CAST(date_trunc('{period}', CAST(started_at AT TIME ZONE 'UTC' AS DATE)) AS DATE)"
    value = "ms" if bits is None else f"CASE WHEN length(bin(ms)) <= {bits} THEN ms ELSE (ms // (1 << (length(bin(ms)) - {bits}))) * (1 << (length(bin(ms)) - {bits})) END"
    at = lambda q: f"min(CASE WHEN upto >= ceil(round({q} * total, 6)) THEN value END)"
    return f"""WITH once AS (SELECT * FROM serving_runs WHERE {clean('request_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {clean('request_id')} ORDER BY arrived_at) = 1),
m AS (SELECT {_MODE} AS serving_mode, {start} AS {period}, 'queue_wait_ms' AS metric, measurements.queue_wait_ms AS ms FROM once
  UNION ALL SELECT {_MODE}, {start}, 'service_ms', measurements.service_ms FROM once),
ok AS (SELECT serving_mode, {period}, metric, {value} AS value FROM m WHERE ms BETWEEN 0 AND 86400000),
ranked AS (SELECT *, row_number() OVER (PARTITION BY serving_mode, {period}, metric ORDER BY value) AS upto, count(*) OVER (PARTITION BY serving_mode, {period}, metric) AS total FROM ok)
SELECT serving_mode, {period}, metric, max(total) AS n, {at(0.5)} AS p50, {at(0.9)} AS p90, {at(0.95)} AS p95, {at(0.99)} AS p99, CAST({0.0 if bits is None else 2.0 ** (1 - bits)} AS DOUBLE) AS relative_error
FROM ranked GROUP BY ALL"""


_MONTH = "strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m')"
_REFS = f"""WITH refs AS (
  SELECT 'work_units' AS src_table, id AS src_id, 'requirement_id' AS field, 'r' AS target, {clean('requirement_id', True)} AS ref_id, {_MONTH} AS period FROM work_units
  UNION SELECT 'work_units', id, 'blocked_by', 'r', upper(nullif(regexp_extract({clean('e')}, '(?i)^(REQ-[A-Z0-9_]+-[0-9]{{7}})([^0-9]|$)', 1), '')), period FROM (SELECT id, unnest(blocked_by) AS e, {_MONTH} AS period FROM work_units)
  UNION SELECT 'spec_nodes', id, 'satisfies', 'r', {clean('e', True)}, period FROM (SELECT id, unnest(satisfies) AS e, {_MONTH} AS period FROM spec_nodes)
  UNION SELECT 'code_bindings', CAST(binding_id AS VARCHAR), 'node_id', 'n', {clean('node_id')}, {_MONTH} FROM code_bindings),
there AS (
  SELECT 'r' AS target, {clean('id', True)} AS ref_id, arrived_at, deleted_at FROM requirements
  UNION ALL SELECT 'n', {clean('id')}, arrived_at, deleted_at FROM nodes
  UNION ALL SELECT 'n', {clean('id')}, arrived_at, NULL FROM shared_nodes),
spans AS (SELECT DISTINCT target, ref_id, strftime(arrived_at AT TIME ZONE 'UTC', '%Y-%m') AS first, strftime(deleted_at AT TIME ZONE 'UTC', '%Y-%m') AS gone FROM there),
judged AS (SELECT *, NOT EXISTS (SELECT 1 FROM spans s WHERE s.target = refs.target AND s.ref_id = refs.ref_id AND s.first <= refs.period AND (s.gone IS NULL OR s.gone > refs.period)) AS orphan FROM refs WHERE ref_id IS NOT NULL AND period IS NOT NULL)
"""

_LINKS = f"""WITH RECURSIVE links AS (SELECT {clean('to_id', True)} AS node, min({clean('from_id', True)}) AS parent FROM plan_edges WHERE kind = 'child' AND {clean('to_id')} IS NOT NULL AND {clean('from_id')} IS NOT NULL GROUP BY 1),
ids AS (SELECT node FROM links UNION SELECT parent FROM links),
tops AS (SELECT node FROM ids WHERE node NOT IN (SELECT node FROM links)),
"""
_TREE = """tree AS (SELECT node AS node_id, node AS root_id, 0 AS depth, node AS path FROM tops
  UNION ALL SELECT l.node, t.root_id, t.depth + 1, t.path || ' > ' || l.node FROM tree t JOIN links l ON l.parent = t.node_id),
"""
#: Subtree sizes, siblings in order (largest first, then by MD5 and id), preorder numbers.
_ORDERED = _LINKS + _TREE + """pairs AS (SELECT node_id AS a, node_id AS b FROM tree UNION ALL SELECT p.a, l.node FROM pairs p JOIN links l ON l.parent = p.b),
sized AS (SELECT a AS node, count(*) AS size FROM pairs GROUP BY 1),
kids AS (SELECT l.parent, l.node, size, row_number() OVER (PARTITION BY l.parent ORDER BY size DESC, l.node DESC) = 1 AS heavy FROM links l JOIN sized s ON s.node = l.node),
placed AS (SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY parent ORDER BY heavy DESC, substr(md5(node), 1, 2), node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM kids),
walk AS (SELECT t.node AS node_id, t.node AS root_id, 0 AS depth, t.node AS path, CAST(0 AS BIGINT) AS preorder, size FROM tops t JOIN sized s ON s.node = t.node
  UNION ALL SELECT p.node, w.root_id, w.depth + 1, w.path || ' > ' || p.node, CAST(w.preorder + p.shift AS BIGINT), p.size FROM walk w JOIN placed p ON p.parent = w.node_id)
"""


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


def _opened(x: str) -> str:
    """JSON written as text, up to four times over."""
    text = r"regexp_replace(a->>'$', '^[\s\x{FEFF}]+|[\s\x{FEFF}]+$', '', 'g')"
    return f"list_reduce([{x}, NULL, NULL, NULL, NULL], lambda a, b: CASE WHEN json_type(a) = 'VARCHAR' AND json_valid({text}) THEN CASE WHEN json_type(TRY_CAST({text} AS JSON)) IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN TRY_CAST({text} AS JSON) ELSE a END ELSE a END)"


def _evened(k: str, v: str) -> str:
    u = _opened(v)
    return f"""CASE WHEN {k} IN {_in(shred.OBJECT_FIELDS)} THEN CASE WHEN json_type({u}) = 'ARRAY' AND json_array_length({u}) = 1 THEN {_opened(f"json_extract({u}, '$[0]')")} ELSE {u} END
WHEN {k} IN {_in(shred.LIST_FIELDS)} THEN CASE json_type({u}) WHEN 'OBJECT' THEN json_array({u}) WHEN 'ARRAY' THEN CAST('[' || array_to_string(list_transform(json_extract({u}, '$[*]'), lambda q: CAST({_opened('q')} AS VARCHAR)), ',') || ']' AS JSON) ELSE {u} END ELSE {v} END"""


_HEAD = "string_split(k, '.')[1]"
_DOTTED = f"(contains(k, '.') AND {_HEAD} IN {_in(shred.OBJECT_FIELDS)} AND length(k) > length({_HEAD}) + 1)"
_KEY = """('$."' || k || '"')"""
#: Every object and list of every payload with its path, in one notation.
_WALK = rf"""WITH RECURSIVE raw AS (SELECT record_id, regexp_replace(payload, '^[\s\x{{FEFF}}]+|[\s\x{{FEFF}}]+$', '', 'g') AS t FROM receipt_records WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY received_at) = 1),
roots AS (SELECT record_id, {_opened('TRY_CAST(t AS JSON)')} AS r FROM raw WHERE json_valid(t)),
walk AS (SELECT record_id, '' AS path, CASE WHEN json_type(r) = 'ARRAY' THEN CAST('[' || array_to_string(list_transform(json_extract(r, '$[*]'), lambda q: CAST({_opened('q')} AS VARCHAR)), ',') || ']' AS JSON) ELSE r END AS node FROM roots WHERE json_type(r) IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT record_id, c.path, c.node FROM (SELECT record_id, unnest(CASE json_type(node) WHEN 'OBJECT' THEN list_transform(json_keys(node), lambda k: CASE WHEN {_DOTTED} THEN {{'path': CASE WHEN path = '' THEN '' ELSE path || '.' END || {_HEAD}, 'node': json_object(substr(k, length({_HEAD}) + 2), json_extract(node, {_KEY}))}} ELSE {{'path': CASE WHEN path = '' THEN '' ELSE path || '.' END || k, 'node': {_evened('k', f'json_extract(node, {_KEY})')}}} END) ELSE list_transform(range(CAST(json_array_length(node) AS BIGINT)), lambda i: {{'path': path || '[' || i || ']', 'node': json_extract(node, '$[' || i || ']')}}) END) AS c FROM walk) WHERE json_type(c.node) IN ('OBJECT', 'ARRAY'))
"""
_PARENT = r"regexp_replace(regexp_replace(path, '(\.|^)[^.\[\]]+(\[\d+\])*$', ''), '^(\[\d+\])$', '\1')"


def _flat_sql(name: str) -> str:
    path, columns = shred.TABLES[name]
    where = r"^(\[\d+\]\.)?" + path.replace("[]", r"\[\d+\]").replace(".", r"\.") + "$"
    value = lambda c: f"max(CASE WHEN json_type(node, '$.{c}') NOT IN ('OBJECT', 'ARRAY') THEN node->>'$.{c}' END)"
    cast = lambda c, t: value(c) if t == "string" else f"TRY_CAST(trim({value(c)}) AS DOUBLE)" if t == "double" else f"CAST(TRY_CAST(trim({value(c)}) AS DECIMAL(38, 0)) AS BIGINT)"
    return _WALK + f"SELECT record_id, path AS node_path, {_PARENT} AS parent_path, " + ", ".join(f"{cast(c, t)} AS {c}" for c, t in columns.items()) + f" FROM walk WHERE json_type(node) = 'OBJECT' AND regexp_matches(path, '{where}') GROUP BY ALL"


def _values_sql(name: str) -> str:
    where = r"^(\[\d+\]\.)?" + shred.VALUE_LISTS[name].removesuffix("[]").replace("[]", r"\[\d+\]").replace(".", r"\.") + "$"
    return _WALK + f", v AS (SELECT record_id, path, unnest(range(CAST(json_array_length(node) AS BIGINT))) AS i, node FROM walk WHERE json_type(node) = 'ARRAY' AND regexp_matches(path, '{where}')) SELECT record_id, path || '[' || i || ']' AS node_path, {_PARENT} AS parent_path, node->>('$[' || i || ']') AS value FROM v WHERE json_type(node, '$[' || i || ']') NOT IN ('OBJECT', 'ARRAY', 'NULL')"


def sql() -> dict[str, str]:
    p2 = {"p2_found": _WALK + "SELECT DISTINCT record_id, path AS node_path FROM walk WHERE path <> '' AND json_type(node) = 'OBJECT'"}
    p2 |= {f"p2_{n}": _flat_sql(n) for n in shred.TABLES} | {f"p2_{n}": _values_sql(n) for n in shred.VALUE_LISTS}
    return p2 | {
        "p1_found": _EDGES + "SELECT node_id, direction FROM entries WHERE node_id IS NOT NULL GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM once)",
        "p1_degrees": _EDGES + "SELECT node_id, direction, kind, count(*) AS n_edges FROM entries WHERE node_id IS NOT NULL GROUP BY ALL",
        "p1_through": _EDGES + "SELECT node_id, n_in, n_out, n_in * n_out AS through FROM (SELECT node_id, count(*) FILTER (direction = 'incoming') AS n_in, count(*) FILTER (direction = 'outgoing') AS n_out FROM entries WHERE node_id IS NOT NULL GROUP BY node_id)",
        "p1_file_traffic": _EDGES + f", places AS (SELECT DISTINCT {clean('id')} AS node_id, file FROM nodes UNION SELECT DISTINCT {clean('id')}, file FROM shared_nodes) SELECT file, kind, count(*) AS n_edges FROM (SELECT * FROM entries WHERE direction = 'incoming' AND node_id IS NOT NULL) LEFT JOIN places USING (node_id) GROUP BY ALL",
        "p3_daily": _serving_sql("day"),
        "p3_weekly": _serving_sql("week"),
        "p3_monthly": _serving_sql("month"),
        "p3_monthly_bounded": _serving_sql("month", 8),
        "p3_monthly_stored": _serving_sql("month"),
        "p4_keys": _REFS + "SELECT CASE target WHEN 'r' THEN 'requirements' ELSE 'nodes' END AS target, ref_id, period, count(*) AS n_refs FROM judged WHERE orphan GROUP BY ALL",
        "p4_found": _REFS + "SELECT src_table, src_id, field, ref_id, period FROM judged WHERE orphan",
        "p4_counts": _REFS + "SELECT src_table, field, period, count(*) AS n_refs, CAST(sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans FROM judged GROUP BY ALL",
        "p5_found": _LINKS + _TREE + f"""
ups AS (SELECT node, parent AS up FROM links WHERE node NOT IN (SELECT node_id FROM tree) UNION SELECT u.node, l.parent FROM ups u JOIN links l ON l.node = u.up),
deps AS (SELECT DISTINCT * FROM (SELECT a, {clean('e', True)} AS b FROM (SELECT {clean('requirement_id', True)} AS a, unnest(depends_on) AS e FROM work_units)) WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, b FROM deps UNION SELECT r.a, d.b FROM reach r JOIN deps d ON d.a = r.b)
SELECT 'child' AS relation, node_id, root_id, depth FROM tree
UNION ALL SELECT 'child', u.node, min(u.up), -1 FROM ups u WHERE (u.up, u.up) IN (SELECT node, up FROM ups) GROUP BY u.node
UNION ALL SELECT 'depends_on', r.a, min(r.b), -1 FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY r.a""",
        "p5_paths": _ORDERED + "SELECT node_id, root_id, depth, path, preorder, size - 1 AS n_descendants FROM walk",
        "p5_descendants": _ORDERED + "SELECT node_id, root_id, depth, preorder, preorder + size - 1 AS last FROM walk",
    }
