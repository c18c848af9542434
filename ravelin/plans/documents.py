"""Queries over contract and requirement documents and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import lint
from ravelin.sources import specs
from ravelin.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """All documents: those that don't follow the format hold fewer sections and scenarios, or none."""
    return table(spark, d, "documents").select("doc_id", "text")


def _flat(df: DataFrame) -> DataFrame:
    """Arrays of strings as joined strings."""
    return df.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def _of(f):
    return lambda spark, d: _flat(f(_docs(spark, d)))


def _every(f):
    return lambda spark, d: f(table(spark, d, "documents").select("doc_id", "text"))


def first_term_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Per language, how many documents have which term first."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    rows = docs.select("lang", lint.term_in(F.col("text"), lint.NONDETERMINISTIC).alias("term")).where(F.col("term").isNotNull())
    return rows.groupBy("lang", "term").agg(F.count("*").alias("n"))


def acknowledged(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics with the documents' reviews of quality 4 and 5 standing for acknowledgements of one rule."""
    acks = table(spark, d, "labels").where("quality >= 4").select("doc_id", F.lit("bdd-scenario-shape").alias("code"))
    return lint.split_acknowledged(lint.lint(_docs(spark, d), ["bdd-scenario-shape", "explicit-test-binding"]), acks)


def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("symbol").distinct().select("symbol", F.array_join(T.identifier_segments("symbol"), " ").alias("segments"), T.normalized_identifier("symbol").alias("normalized"), T.slug("symbol", "test_").alias("slug"), T.mermaid_id("symbol").alias("mermaid"), T.truncated("symbol", 20).alias("short"))


#: Rules on what decisions and constraints promise and no scenario verifies.
COVERAGE = ["coverage", "decision-coverage", "observable-decision-coverage", "output-mode-coverage", "precedence-fallback-coverage", "universal-claim", "boundary-entry-point", "flag-combination-coverage", "platform-decision-tag"]

NAMED = {
    "spec_lines": lambda spark, d: specs.lines(_docs(spark, d)),
    "spec_meta": _of(specs.spec_meta),
    "spec_sections": _of(specs.sections),
    "spec_boundaries": _of(specs.boundaries),
    "spec_decisions": _of(specs.decisions),
    "spec_scenarios": _of(specs.scenarios),
    "spec_steps": _of(specs.steps),
    "spec_clauses": _of(specs.clauses),
    "spec_questions": _of(specs.open_questions),
    "referenced_ids": _every(specs.referenced_ids),
    "lint_first_term_by_lang": first_term_by_lang,
    "spec_selectors": _of(specs.selector_fields),
    "lint_terms": lambda spark, d: lint.lint(_docs(spark, d), list(lint.TERM_RULES)),
    "lint_structure": lambda spark, d: lint.lint(_docs(spark, d), ["explicit-test-binding", "scenario-presence", "error-path", "bdd-scenario-shape"]),
    "lint_coverage": lambda spark, d: lint.lint(_docs(spark, d), COVERAGE),
    "lint_scenarios": lambda spark, d: lint.lint(_docs(spark, d), ["external-io-error-strength", "verification-metadata-suggestion", "implicit-dep", "circular-dependency"]),
    "lint_rules": lambda spark, d: lint.lint(_docs(spark, d), ["bdd-rule-id", "bdd-rule-grouping", "open-question"]),
    "lint_contradictions": lambda spark, d: lint.decision_contradictions(specs.parsed(_docs(spark, d))),
    "lint_decision_coverage": lambda spark, d: lint.lint(_docs(spark, d), ["decision-coverage"]),
    "lint_clauses": lambda spark, d: lint.lint(_docs(spark, d), ["requirement-clauses"]),
    "lint_report": lambda spark, d: lint.lint(_docs(spark, d)).groupBy("rule", "severity").agg(F.count("*").alias("n")),
    "lint_acknowledged": acknowledged,
    "quality_score": lambda spark, d: lint.quality(_docs(spark, d), lint.lint(_docs(spark, d), ["determinism", "testability", "coverage"])),
    "dimension_counts": lambda spark, d: lint.dimension_counts(lint.lint(_docs(spark, d), ["determinism", "testability", "explicit-test-binding", "bdd-scenario-shape"])),
    "audit": _of(lint.audit),
    "identifier_parts": identifier_parts,
}


def queries() -> dict:
    return dict(NAMED)


_S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def s(x: str) -> str:
    return _S.format(x)


RULE_LINE = "regexp_matches(bare, '^(规则|(?i:rule))[:：]')"
_BASE = rf"""WITH docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
heads AS (SELECT *, regexp_matches(line, '^\s*##?\s+\S') AS head, {s(f"regexp_replace({s('line')}, '^#+', '')")} AS bare FROM lines),
placed AS (SELECT *, count(*) FILTER (head) OVER w AS section_no, last_value(CASE WHEN head THEN bare END IGNORE NULLS) OVER w AS heading FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
sect AS (SELECT doc_id, section_no, heading, line_no, line, CASE WHEN regexp_matches(lower(heading), '^(意图|intent)') THEN 'intent' WHEN regexp_matches(lower(heading), '^(约束|constraint)') THEN 'constraints' WHEN regexp_matches(lower(heading), '^(已定决策|决策|decision)') THEN 'decisions' WHEN regexp_matches(lower(heading), '^(边界|boundaries|boundary)') THEN 'boundaries' WHEN regexp_matches(lower(heading), '^(验收标准|acceptance criter|完成条件|completion criter)') THEN 'acceptance' WHEN regexp_matches(lower(heading), '^(排除范围|out of scope)') THEN 'out_of_scope' WHEN regexp_matches(lower(heading), '^(问题|待澄清|questions)') THEN 'questions' END AS kind FROM placed WHERE NOT head AND section_no > 0),
named AS (SELECT *, CASE WHEN regexp_matches(bare, '^(场景|示例|例子|(?i:scenario|example))[:：]') THEN {s("regexp_extract(bare, '^[^:：]*[:：](.*)$', 1)")} END AS name FROM heads),
ruled AS (SELECT *, CASE WHEN {RULE_LINE} THEN {s("regexp_extract(bare, '^[^:：]*[:：](.*)$', 1)")} END AS content, nullif(regexp_extract({s("regexp_extract(bare, '^[^:：]*[:：](.*)$', 1)")}, '^([a-z0-9]+(?:-[a-z0-9]+)*)(?:\s*—|\s{{2,}}|$)', 1), '') AS rid FROM named),
rules AS (SELECT doc_id, line_no, content, rid FROM ruled WHERE content IS NOT NULL),
scoped AS (SELECT *, nullif(last_value(CASE WHEN content IS NOT NULL THEN coalesce(rid, '') WHEN head AND name IS NULL THEN '' END IGNORE NULLS) OVER w, '') AS rule, count(name) OVER w AS scenario_no, last_value(CASE WHEN name IS NOT NULL THEN name WHEN head OR content IS NOT NULL THEN '' END IGNORE NULLS) OVER w AS scenario, last_value(CASE WHEN name IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS header_line FROM ruled WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
scen AS (SELECT * FROM scoped WHERE scenario <> ''),
stepping AS (SELECT *, {s('line')} AS t FROM scen WHERE line_no > header_line),
kinds AS (SELECT *, CASE WHEN t LIKE '假设%' OR t ILIKE 'given %' THEN 'given' WHEN t LIKE '当%' OR t ILIKE 'when %' THEN 'when' WHEN t LIKE '那么%' OR t ILIKE 'then %' THEN 'then' WHEN t LIKE '并且%' OR t ILIKE 'and %' THEN 'and' WHEN t LIKE '但是%' OR t ILIKE 'but %' THEN 'but' END AS kind FROM stepping),
steps AS (SELECT doc_id, scenario_no, scenario, row_number() OVER (PARTITION BY doc_id, scenario_no ORDER BY line_no) AS step_no, kind, {s("regexp_replace(t, '^(假设|当|那么|并且|但是|(?i:given|when|then|and|but) )', '')")} AS step, line FROM kinds WHERE kind IS NOT NULL),
scenarios AS (SELECT doc_id, scenario_no, scenario, rule, header_line AS line_no, nullif(max(CASE WHEN regexp_matches({s('line')}, '^(?i:test|测试)[:：]') THEN {s("regexp_extract(line, '^[^:：]*[:：](.*)$', 1)")} END), '') AS selector FROM scen GROUP BY ALL),
lv AS (SELECT doc_id, arg_max(lower({s("replace(regexp_extract(line, '^[^:]*:(.*)$', 1), chr(34), '')")}), line_no) AS level FROM lines JOIN (SELECT doc_id, min(line_no) AS mark FROM lines WHERE {s('line')} = '---' AND line_no > 1 GROUP BY 1) USING (doc_id) WHERE line_no < mark AND regexp_matches(line, '^\s*(?i:spec)\s*:') GROUP BY doc_id),
task AS (SELECT doc_id FROM lv WHERE level = 'task'),
items AS (SELECT doc_id, kind, line_no, {s("regexp_extract(line, '^\\s*-(.*)$', 1)")} AS text FROM sect WHERE kind IN ('constraints', 'decisions') AND regexp_matches(line, '^\s*-\s*\S')),
intents AS (SELECT doc_id, {s("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM sect WHERE kind = 'intent' GROUP BY doc_id, section_no),
texts AS (SELECT doc_id, scenario_no, lower(scenario) AS t FROM scenarios UNION ALL SELECT doc_id, scenario_no, lower(step) FROM steps),
tx AS (SELECT doc_id, list(DISTINCT t) AS ts FROM texts GROUP BY doc_id),
sx AS (SELECT doc_id, list(DISTINCT lower(step)) AS ts FROM steps GROUP BY doc_id)
"""


BOUNDARIES = _BASE + rf", cat AS (SELECT *, coalesce(last_value(CASE WHEN {s('line')} LIKE '###%' THEN CASE WHEN regexp_matches(lower(line), '允许修改|allow') THEN 'allow' WHEN regexp_matches(lower(line), '禁止|forbidden|must not') THEN 'deny' WHEN regexp_matches(lower(line), 'symbols|符号') THEN 'symbols' END END IGNORE NULLS) OVER (PARTITION BY doc_id, section_no ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'general') AS category FROM sect WHERE kind = 'boundaries'), bounds AS (SELECT doc_id, line_no, category, {s("regexp_extract(line, '^\\s*-(.*)$', 1)")} AS item FROM cat WHERE regexp_matches(line, '^\s*-\s*\S')) "


def _first(x: str, terms: tuple[list[str], list[str]]) -> str:
    cases = [f"WHEN contains({x}, '{t}') THEN '{t}'" for t in terms[0]] + [f"WHEN contains(lower({x}), '{t}') THEN '{t}'" for t in terms[1]]
    return f"CASE {' '.join(cases)} END"


def _terms(rule: str, source: str, x: str, terms, severity: str = "warning", line: str = "NULL") -> str:
    return f"SELECT doc_id, '{rule}' AS rule, '{severity}' AS severity, CAST({line} AS INTEGER) AS line_no, {_first(x, terms)} AS detail FROM {source} WHERE {_first(x, terms)} IS NOT NULL"


_ERROR = _first("t", lint.ERROR_TERMS)
_SHAPE = "SELECT doc_id, 'bdd-scenario-shape' AS rule, 'warning' AS severity, CAST(NULL AS INTEGER) AS line_no, scenario || ': ' || p AS detail FROM (SELECT doc_id, scenario, unnest(ps) AS p FROM (SELECT doc_id, scenario_no, scenario, [CASE WHEN count(*) FILTER (kind = 'when') = 0 THEN 'no when' END, CASE WHEN count(*) FILTER (kind = 'then') = 0 THEN 'no then' END, CASE WHEN arg_min(kind, step_no) IN ('and', 'but') THEN 'opens with and or but' END] AS ps FROM steps GROUP BY doc_id, scenario_no, scenario)) WHERE p IS NOT NULL"
_UNBOUND = "SELECT doc_id, 'explicit-test-binding' AS rule, 'error' AS severity, CAST(line_no AS INTEGER) AS line_no, scenario AS detail FROM scenarios WHERE selector IS NULL AND doc_id IN (SELECT doc_id FROM task)"
_DETERMINISM = _terms("determinism", "steps", "step", lint.NONDETERMINISTIC)
_TESTABILITY = _terms("testability", "(SELECT * FROM steps WHERE kind IN ('then', 'and'))", "step", lint.UNTESTABLE)
_CONSTRAINTS = "(SELECT * FROM items WHERE kind = 'constraints')"
_quoted = lambda terms: ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def _has(x: str, terms: list[str]) -> str:
    return f"len(list_filter([{_quoted(terms)}], lambda z: contains({x}, z))) > 0"


def _some(texts: str, terms: str) -> str:
    return f"len(list_filter(coalesce({texts}, []), lambda t: len(list_filter({terms}, lambda k: contains(t, lower(k)))) > 0)) > 0"


_TERMS = " UNION ALL ".join([
    _terms("vague-verb", _CONSTRAINTS, "text", lint.VAGUE_VERBS, line="line_no"), _terms("vague-verb", "intents", "text", lint.VAGUE_VERBS, "info"), _terms("unquantified", _CONSTRAINTS, "text", lint.UNQUANTIFIED, line="line_no"), _TESTABILITY, _DETERMINISM,
    _terms("sycophancy", _CONSTRAINTS, "text", lint.BUG_HUNTING, line="line_no"), _terms("sycophancy", "intents", "text", lint.BUG_HUNTING), _terms("sycophancy", "steps", "step", lint.BUG_HUNTING),
    _terms("bdd-implementation-detail", "steps", "step", lint.UI_TERMS, "info").replace(_first("step", lint.UI_TERMS), "CASE " + " ".join([f"WHEN contains(lower(step), '{t}') THEN '{t}'" for t in lint.UI_TERMS[1]] + [f"WHEN contains(step, '{t}') THEN '{t}'" for t in lint.UI_TERMS[0]]) + " END"),
])
_STRUCTURE = " UNION ALL ".join([
    _UNBOUND, "SELECT doc_id, 'scenario-presence', 'error', CAST(NULL AS INTEGER), 'no scenario' FROM task WHERE doc_id NOT IN (SELECT doc_id FROM scenarios)",
    f"SELECT doc_id, 'error-path', 'warning', CAST(NULL AS INTEGER), 'no error scenario' FROM (SELECT doc_id, scenario AS t FROM scenarios UNION ALL SELECT doc_id, step FROM steps) WHERE doc_id IN (SELECT doc_id FROM task) GROUP BY doc_id HAVING count({_ERROR}) = 0", _SHAPE,
])
_KEYS = r"list_filter(regexp_split_to_array(text, '[\s,、。]'), lambda w: strlen(w) >= 2 AND lower(w) NOT IN (" + _quoted(T.STOP_WORDS) + "))"
_DKEYS = r"list_concat(list_filter(regexp_extract_all(text, '`([^`]*)`', 1), lambda w: w <> ''), list_filter(regexp_split_to_array(text, '[\s,、。`]'), lambda w: strlen(w) > 2 AND lower(w) NOT IN (" + _quoted(lint.DECISION_STOP) + ")))"


def _diag(rule: str, severity: str, detail: str, source: str, line: str = "line_no") -> str:
    return f"SELECT doc_id, '{rule}' AS rule, '{severity}' AS severity, CAST({line} AS INTEGER) AS line_no, {detail} AS detail FROM {source}"


_TASK = "doc_id IN (SELECT doc_id FROM task)"
_DECISION_COVERAGE = _diag("decision-coverage", "warning", "text", f"(SELECT *, {_DKEYS} AS ks FROM items LEFT JOIN tx USING (doc_id)) WHERE kind = 'decisions' AND {_TASK} AND len(ks) > 0 AND NOT {_some('ts', 'ks')}")
_CONSTRAINT_COVERAGE = _diag("coverage", "warning", "text", f"(SELECT *, {_KEYS} AS ks FROM items LEFT JOIN sx USING (doc_id)) WHERE kind = 'constraints' AND len(ks) > 0 AND NOT {_some('ts', 'ks')}")
_MODES = "list_filter([" + ", ".join(f"CASE WHEN {_has('lower(text)', ask)} THEN '{m}' END" for m, ask, _ in lint.OUTPUT_MODES) + "], lambda x: x IS NOT NULL)"
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN list_contains(asked, '{m}') AND NOT {_some('ts', '[' + _quoted(cover) + ']')} THEN '{m}' END" for m, _, cover in lint.OUTPUT_MODES) + "], lambda x: x IS NOT NULL)"
_CHAIN = "list_filter(list_transform(string_split(text, '->'), lambda x: lower(" + s("x") + ")), lambda x: x <> '')"
_ORDER = f"CASE WHEN contains(text, '->') AND len({_CHAIN}) >= 2 THEN {_CHAIN} WHEN {_has('lower(text)', lint.ORDER_WORDS)} AND len(({_DKEYS})[1:4]) >= 2 THEN ({_DKEYS})[1:4] END"
_FLAGS = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {_has(x, terms)} THEN '{f}' END" for f, terms in lint.FLAGS.items()) + "], lambda x: x IS NOT NULL)"
_COVERED = " UNION ALL ".join([
    _CONSTRAINT_COVERAGE, _DECISION_COVERAGE,
    _diag("observable-decision-coverage", "warning", "text", f"(SELECT *, {_DKEYS} AS ks FROM items LEFT JOIN tx USING (doc_id)) WHERE kind = 'decisions' AND {_TASK} AND {_has('lower(text)', lint.OBSERVABLE)} AND NOT {_some('ts', 'ks')}"),
    _diag("output-mode-coverage", "warning", "array_to_string(missing, ', ')", f"(SELECT doc_id, {_MISSING} AS missing FROM (SELECT doc_id, list(DISTINCT m) AS asked FROM (SELECT doc_id, unnest({_MODES}) AS m FROM (SELECT doc_id, text FROM items UNION ALL SELECT doc_id, text FROM intents)) WHERE {_TASK} GROUP BY doc_id) LEFT JOIN tx USING (doc_id)) WHERE len(missing) > 0", "NULL"),
    _diag("precedence-fallback-coverage", "warning", "text", f"(SELECT *, {_ORDER} AS terms FROM items LEFT JOIN tx USING (doc_id) WHERE {_TASK}) WHERE terms IS NOT NULL AND len(list_filter(coalesce(ts, []), lambda t: len(list_filter(terms, lambda k: contains(t, k))) >= 2 OR {_has('t', lint.ORDER_COVERED)})) = 0"),
    f"SELECT * FROM ({_terms('universal-claim', 'items', 'text', lint.UNIVERSAL, line='line_no')}) WHERE {_TASK} AND doc_id NOT IN (SELECT doc_id FROM scenarios GROUP BY 1 HAVING count(*) >= 2)",
    _diag("boundary-entry-point", "warning", "item", f"(SELECT *, regexp_extract(final, '^([^.]*)', 1) AS stem FROM (SELECT *, lower(regexp_replace(regexp_extract(item, '([^/]*)$', 1), '[*]*[.]*$', '')) AS final, count(*) OVER (PARTITION BY doc_id) AS n FROM bounds WHERE category = 'allow' AND {_TASK} AND {_has('lower(item)', lint.ENTRY_POINTS)}) LEFT JOIN tx USING (doc_id)) WHERE n >= 2 AND final <> '' AND len(list_filter(coalesce(ts, []), lambda t: contains(t, final) OR (strlen(stem) > 2 AND contains(t, stem)))) = 0"),
    _diag("flag-combination-coverage", "warning", "array_to_string(list_sort(flags), ', ')", f"(SELECT doc_id, list(DISTINCT f) AS flags FROM (SELECT doc_id, unnest({_FLAGS('lower(text)')}) AS f FROM items) WHERE {_TASK} GROUP BY doc_id) n WHERE len(flags) >= 2 AND NOT EXISTS (SELECT 1 FROM (SELECT doc_id, list(DISTINCT f) AS used FROM (SELECT doc_id, scenario_no, unnest({_FLAGS('t')}) AS f FROM texts) GROUP BY doc_id, scenario_no) u WHERE u.doc_id = n.doc_id AND len(list_intersect(flags, used)) >= 2)", "NULL"),
    f"SELECT * FROM ({_terms('platform-decision-tag', '(SELECT * FROM items WHERE kind = ' + chr(39) + 'decisions' + chr(39) + ')', 'text', ([], lint.PLATFORM_TERMS), 'info', 'line_no')}) p WHERE {_TASK} AND EXISTS (SELECT 1 FROM items i WHERE i.doc_id = p.doc_id AND i.line_no = p.line_no AND NOT {_has('lower(i.text)', lint.PLATFORM_MARKS)})",
])
_AFTER = s("regexp_extract(line, '^[^:：]*[:：](.*)$', 1)")
_FIELD = lambda words: f"arg_max({_AFTER}, line_no) FILTER (regexp_matches(bare, '^(?i:{words})[:：]'))"
_below = lambda words: f"max(CASE WHEN regexp_matches({s('line')}, '^(?i:{words})[:：]') THEN {_AFTER} END)"
_listed = lambda c: f"array_to_string(list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: {s('x')}), lambda x: x <> ''), '|')"
_FIELDS = "fields AS (SELECT doc_id, scenario_no, scenario, " + ", ".join(f"{_FIELD(w)} AS {n}" for n, w in specs.SELECTOR_FIELDS.items()) + " FROM scen GROUP BY ALL)"
_BLOBS = f"{_FIELDS}, blobs AS (SELECT b.doc_id, b.scenario_no, s.scenario, s.line_no, s.selector, f.* EXCLUDE (doc_id, scenario_no, scenario), ts FROM (SELECT doc_id, scenario_no, list(t) AS ts FROM texts WHERE {_TASK} GROUP BY ALL) b JOIN scenarios s USING (doc_id, scenario_no) JOIN fields f USING (doc_id, scenario_no)), io AS (SELECT *, list_concat(ts, [lower(concat_ws(' ', selector, package, filter, level, test_double, targets))]) AS tl FROM blobs WHERE {_some('ts', '[' + _quoted(lint.EXTERNAL_IO) + ']')})"
_IO = " UNION ALL ".join([
    _diag("external-io-error-strength", "warning", "scenario", f"io WHERE {_some('ts', '[' + _quoted([t.lower() for t in (*lint.ERROR_TERMS[1], *lint.ERROR_TERMS[0])]) + ']')} AND {_some('tl', '[' + _quoted(lint.WEAK_IO) + ']')} AND NOT {_some('tl', '[' + _quoted(lint.STRONG_IO) + ']')}"),
    _diag("verification-metadata-suggestion", "warning", "scenario", "io WHERE level IS NULL AND test_double IS NULL AND targets IS NULL"),
])
_PARAMS = """list_filter(regexp_extract_all(line, '["“]([^"“”]*)["”]', 1), lambda x: x <> '')"""
_IMPLICIT = f"SELECT DISTINCT doc_id, 'implicit-dep' AS rule, 'warning' AS severity, CAST(NULL AS INTEGER) AS line_no, p AS detail, scenario_no FROM (SELECT doc_id, scenario_no, unnest({_PARAMS}) AS p FROM steps WHERE kind IN ('when', 'then')) u WHERE NOT (regexp_matches(p, '^[0-9.]+$') OR starts_with(p, 'http') OR contains(p, '@')) AND NOT EXISTS (SELECT 1 FROM steps b WHERE b.doc_id = u.doc_id AND b.scenario_no = u.scenario_no AND b.kind IN ('given', 'and') AND list_contains({_PARAMS.replace('line', 'b.line')}, p))"
_DEPENDS = f"deps AS (SELECT doc_id, scenario AS a, unnest(list_filter(list_transform(string_split(coalesce(max(CASE WHEN regexp_matches({s('line')}, '^(?i:depends|依赖)[:：]') THEN {_AFTER} END), ''), ','), lambda x: {s('x')}), lambda x: x <> '')) AS b FROM scen GROUP BY doc_id, scenario_no, scenario), ways AS (SELECT doc_id, a, b FROM deps UNION SELECT w.doc_id, w.a, d.b FROM ways w JOIN deps d ON d.doc_id = w.doc_id AND d.a = w.b)"
_CIRCULAR = _diag("circular-dependency", "error", "scenario", "scenarios WHERE (doc_id, scenario) IN (SELECT (doc_id, a) FROM ways WHERE a = b)")
_RULED = " UNION ALL ".join([
    _diag("bdd-rule-id", "error", "content", "rules WHERE rid IS NULL"),
    _diag("bdd-rule-grouping", "warning", "rid", "rules r WHERE rid IS NOT NULL AND coalesce((SELECT level FROM lv WHERE lv.doc_id = r.doc_id), '') <> 'capability' AND NOT EXISTS (SELECT 1 FROM scenarios z WHERE z.doc_id = r.doc_id AND z.rule = r.rid)"),
    _diag("bdd-rule-grouping", "info", "n || ' scenarios'", "(SELECT doc_id, count(*) AS n FROM scenarios WHERE rule IS NULL GROUP BY 1) WHERE n >= 3 AND doc_id NOT IN (SELECT doc_id FROM rules WHERE rid IS NOT NULL)", "NULL"),
    _diag("open-question", "warning", "question", "questions"),
])
_DASH = s(r"regexp_replace(line, '^\s*-', '')")
_QUESTIONS = rf"""questions AS (SELECT doc_id, line_no, {_DASH} AS question FROM sect WHERE lower(heading) IN ('open questions', 'questions') AND {s('line')} <> '' AND NOT regexp_matches(lower({_DASH}), '^\[x\]|\(resolved\)|^~~|已解决'))"""
_CLAUSES = rf"""clauses AS (SELECT doc_id, line_no, nullif({s(r"regexp_extract(line, '^\s*\[([^\]]+)\]', 1)")}, '') AS clause_id, line, {s(r"regexp_replace(line, '^\s*\[[^\]]+\]', '')")} AS clause FROM sect WHERE lower(heading) = 'requirements' AND {s('line')} <> '' AND {s('line')} NOT LIKE '<!--%'),
kc AS (SELECT doc_id, line_no, clause_id, (SELECT arg_min(k, pos * 100 + i) FROM (SELECT unnest([{', '.join(f"'{T.NORMATIVE_CLASS[k]}'" for k in T.NORMATIVE)}]) AS k, unnest([{', '.join(f"instr(line, '{k}')" for k in T.NORMATIVE)}]) AS pos, unnest(range({len(T.NORMATIVE)})) AS i) WHERE pos > 0) AS keyword, len(list_filter(regexp_split_to_array(line, '[^A-Za-z]'), lambda w: w IN ('MUST', 'SHALL', 'SHOULD', 'MAY', 'REQUIRED', 'RECOMMENDED', 'OPTIONAL'))) AS n_keywords, clause FROM clauses)"""
_CLAUSE_RULES = " UNION ALL ".join(_diag(rule, "warning", "clause", f"kc WHERE {c}") for rule, c in (("requirement-id", "clause_id IS NULL"), ("requirement-keyword", "keyword IS NULL"), ("requirement-single-statement", "n_keywords > 1")))
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_SEG = "list_aggregate(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(symbol, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), 'string_agg', ' ')"


def sql() -> dict[str, str]:
    q = "regexp_matches"
    return {
        "spec_lines": _BASE + "SELECT doc_id, line_no, line FROM lines",
        "spec_meta": _BASE + rf""", marked AS (SELECT *, count(*) FILTER ({s('line')} = '---' AND line_no > 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seen, count(*) FILTER ({s('line')} = '---' AND line_no > 1) OVER (PARTITION BY doc_id) AS marks FROM lines),
pairs AS (SELECT doc_id, lower(regexp_extract(line, '^\s*([A-Za-z_]+)\s*:', 1)) AS k, arg_max(regexp_replace({s("regexp_extract(line, '^[^:]*:(.*)$', 1)")}, '^"(.*)"$', '\1'), line_no) AS v FROM marked WHERE seen = 0 AND marks > 0 AND {q}(line, '^\s*[A-Za-z_]+\s*:') GROUP BY 1, 2),
wide AS (SELECT doc_id, max(v) FILTER (k = 'spec') AS level, max(v) FILTER (k = 'kind') AS kind, max(v) FILTER (k = 'id') AS id, coalesce(max(v) FILTER (k = 'name'), max(v) FILTER (k = 'title')) AS name, max(v) FILTER (k = 'status') AS status, max(v) FILTER (k = 'risk') AS risk, max(v) FILTER (k = 'tags') AS tags, max(v) FILTER (k = 'satisfies') AS satisfies, max(v) FILTER (k = 'depends') AS depends FROM pairs GROUP BY doc_id)
SELECT * REPLACE (regexp_replace(regexp_replace(coalesce(tags, ''), '[\[\]]', '', 'g'), '\s*,\s*', '|', 'g') AS tags, upper(regexp_replace(regexp_replace(coalesce(satisfies, ''), '[\[\]]', '', 'g'), '\s*,\s*', '|', 'g')) AS satisfies, regexp_replace(regexp_replace(coalesce(depends, ''), '[\[\]]', '', 'g'), '\s*,\s*', '|', 'g') AS depends) FROM wide""",
        "spec_sections": _BASE + f"SELECT doc_id, section_no, heading, kind, count(*) AS n_lines FROM sect WHERE {s('line')} <> '' GROUP BY ALL",
        "spec_boundaries": BOUNDARIES + "SELECT * FROM bounds",
        "spec_decisions": _BASE + rf"SELECT doc_id, line_no, {s("regexp_extract(line, '^\\s*-(.*)$', 1)")} AS item FROM sect WHERE kind = 'decisions' AND {q}(line, '^\s*-\s*\S')",
        "spec_scenarios": _BASE + f", n AS (SELECT doc_id, scenario_no, count(*) AS n_steps FROM steps GROUP BY ALL), more AS (SELECT doc_id, scenario_no, {_below('tags?|标签')} AS tags, {_below('review|审核')} AS review, {_below('mode|模式')} AS mode, {_below('depends|依赖')} AS depends_on FROM scen GROUP BY ALL) SELECT s.*, {_listed('tags')} AS tags, review, coalesce(mode, 'standard') AS mode, {_listed('depends_on')} AS depends_on, coalesce(n_steps, 0) AS n_steps FROM scenarios s JOIN more USING (doc_id, scenario_no) LEFT JOIN n USING (doc_id, scenario_no)",
        "spec_steps": _BASE + """SELECT doc_id, scenario_no, scenario, step_no, kind, step, coalesce(list_aggregate(list_filter(regexp_extract_all(line, '["“]([^"“”]*)["”]', 1), lambda x: x <> ''), 'string_agg', '|'), '') AS params FROM steps""",
        "spec_clauses": _BASE + f", {_CLAUSES} SELECT * FROM kc",
        "spec_questions": _BASE + f", {_QUESTIONS} SELECT * FROM questions",
        "spec_selectors": _BASE + f", {_FIELDS} SELECT * FROM fields",
        "referenced_ids": r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b([A-Z]+(?:-[A-Z]+)*-\d+)\b', 1)) AS ref_id FROM documents",
        "lint_first_term_by_lang": f"SELECT lang, {_first('text', lint.NONDETERMINISTIC)} AS term, count(*) AS n FROM documents WHERE {_first('text', lint.NONDETERMINISTIC)} IS NOT NULL GROUP BY ALL",
        "lint_terms": _BASE + _TERMS,
        "lint_structure": _BASE + _STRUCTURE,
        "lint_coverage": BOUNDARIES + _COVERED,
        "lint_scenarios": "WITH RECURSIVE " + _BASE[5:] + f", {_BLOBS}, {_DEPENDS} {_IO} UNION ALL SELECT doc_id, rule, severity, line_no, detail FROM ({_IMPLICIT}) UNION ALL {_CIRCULAR}",
        "lint_rules": _BASE + f", {_QUESTIONS} {_RULED}",
        "lint_contradictions": _BASE + f", said AS (SELECT doc_id, line_no, lower(text) AS x, unnest([{', '.join(f"'{p}'" for p, _ in lint.CONTRADICTIONS)}]) AS positive, unnest([{', '.join(f"'{n}'" for _, n in lint.CONTRADICTIONS)}]) AS negative FROM items WHERE kind = 'decisions'), w AS (SELECT *, unnest(list_distinct(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: strlen(w) > 3))) AS word FROM said) SELECT positive, word, count(*) FILTER (contains(x, positive)) AS n_allow, count(*) FILTER (contains(x, negative)) AS n_deny, min(doc_id) FILTER (contains(x, positive)) AS allow_doc, min(doc_id) FILTER (contains(x, negative)) AS deny_doc FROM w WHERE contains(x, positive) OR contains(x, negative) GROUP BY 1, 2 HAVING n_allow > 0 AND n_deny > 0 AND count(*) > 1",
        "lint_decision_coverage": _BASE + _DECISION_COVERAGE,
        "lint_clauses": _BASE + f", {_CLAUSES} {_CLAUSE_RULES}",
        "lint_report": "WITH RECURSIVE " + BOUNDARIES[5:] + f", {_BLOBS}, {_DEPENDS}, {_QUESTIONS}, {_CLAUSES} SELECT rule, severity, count(*) AS n FROM ({_TERMS} UNION ALL {_STRUCTURE} UNION ALL {_COVERED} UNION ALL {_IO} UNION ALL SELECT doc_id, rule, severity, line_no, detail FROM ({_IMPLICIT}) UNION ALL {_CIRCULAR} UNION ALL {_RULED} UNION ALL {_CLAUSE_RULES}) GROUP BY ALL",
        "lint_acknowledged": _BASE + f", found AS ({_SHAPE} UNION ALL {_UNBOUND}) SELECT *, rule = 'bdd-scenario-shape' AND doc_id IN (SELECT doc_id FROM labels WHERE quality >= 4) AS acknowledged FROM found",
        "quality_score": _BASE + f", c AS (SELECT doc_id, count(*) AS n FROM ({_CONSTRAINT_COVERAGE}) GROUP BY 1), nc AS (SELECT doc_id, count(*) AS n FROM items WHERE kind = 'constraints' GROUP BY 1), d AS (SELECT doc_id, count(*) AS n FROM ({_DETERMINISM}) GROUP BY 1), t AS (SELECT doc_id, count(*) AS n FROM ({_TESTABILITY}) GROUP BY 1), ns AS (SELECT doc_id, count(*) AS n FROM scenarios GROUP BY 1), nt AS (SELECT doc_id, count(*) AS n FROM steps GROUP BY 1), q AS (SELECT docs.doc_id, CASE WHEN ns.n IS NULL THEN 0 ELSE greatest(0.0, 1 - coalesce(d.n, 0) / ns.n) END AS determinism, CASE WHEN nt.n IS NULL THEN 0 ELSE greatest(0.0, 1 - coalesce(t.n, 0) / nt.n) END AS testability, CASE WHEN nc.n IS NULL THEN 1 ELSE greatest(0.0, 1 - coalesce(c.n, 0) / nc.n) END AS coverage FROM docs LEFT JOIN d USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN ns USING (doc_id) LEFT JOIN nt USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN nc USING (doc_id)) SELECT doc_id, CAST(determinism AS DOUBLE) AS determinism, CAST(testability AS DOUBLE) AS testability, CAST(coverage AS DOUBLE) AS coverage, CAST((determinism + testability + coverage) / 3 AS DOUBLE) AS overall FROM q",
        "dimension_counts": _BASE + f", found AS ({_DETERMINISM} UNION ALL {_TESTABILITY} UNION ALL {_UNBOUND} UNION ALL {_SHAPE}) SELECT dimension, count(rule) AS n FROM (SELECT unnest(['clarity', 'consistency', 'coverage', 'determinism', 'testability']) AS dimension) LEFT JOIN found ON dimension = CASE rule WHEN 'determinism' THEN 'determinism' WHEN 'bdd-scenario-shape' THEN 'clarity' ELSE 'testability' END GROUP BY dimension",
        "audit": _BASE + f", {_QUESTIONS} SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(*) FROM rules WHERE rid IS NOT NULL) AS n_rules, (SELECT count(*) FROM scenarios) AS n_scenarios, (SELECT count(*) FROM rules r WHERE rid IS NOT NULL AND coalesce((SELECT level FROM lv WHERE lv.doc_id = r.doc_id), '') <> 'capability' AND NOT EXISTS (SELECT 1 FROM scenarios z WHERE z.doc_id = r.doc_id AND z.rule = r.rid)) AS n_unproven_rules, (SELECT count(*) FROM scenarios WHERE rule IS NULL) AS n_ungrouped, (SELECT count(*) FROM questions) AS n_questions, (SELECT count(*) FROM rules WHERE rid IS NULL) AS n_malformed",
        "identifier_parts": f"SELECT symbol, {_SEG} AS segments, lower(regexp_replace(symbol, '[^A-Za-z0-9]', '', 'g')) AS normalized, 'test_' || regexp_replace(regexp_replace(lower(symbol), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(symbol, '[^A-Za-z0-9_]', '_', 'g') AS mermaid, CASE WHEN length(symbol) > 20 THEN symbol[1:17] || '...' ELSE symbol END AS short FROM (SELECT DISTINCT symbol FROM nodes)",
    }
