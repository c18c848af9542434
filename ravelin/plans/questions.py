"""Queries on evidence, inventories and impact, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import context as C
from ravelin.operators import graph as G
from ravelin.operators import inventory as I
from ravelin.plans import documents, graphs
from ravelin.plans.problems import clean
from ravelin.sources import specs
from ravelin.sources.tables import table

QUESTION = "callers of RoundTracker, EvenZone in src/lib.rs"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.hops(table(spark, d, "edges")), G.current_nodes(table(spark, d, "nodes"), table(spark, d, "shared_nodes"))


def _candidates(spark, d, depth):
    hops, nodes = _graph(spark, d)
    return C.candidates(hops, nodes, C.intent(QUESTION), depth)


def evidence(spark, d, depth: int = 1):
    return _candidates(spark, d, depth).withColumn("reasons", F.array_join("reasons", "|"))


def projection(spark, d, depth: int = 1):
    nodes = _graph(spark, d)[1]
    sizes = nodes.select("id", (F.octet_length("id") + F.octet_length("symbol")).alias("bytes"))
    rows = C.project(_candidates(spark, d, depth), sizes, 8000, 400)
    return rows.groupBy("class", "state").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def modules(spark, d):
    return I.modules(_graph(spark, d)[1])


def module_edges(spark, d):
    return I.module_edges(*_graph(spark, d))


def text_ranking(spark, d):
    return I.ranked_texts(table(spark, d, "documents"), "fingerprint", 50, ["text", "source", "doc_kind"])


def stale_articles(spark, d):
    """Guides and api docs, their own path standing for what they describe, against the files of nodes that came in June."""
    docs = table(spark, d, "documents").where(F.col("source_path").isNotNull() & F.col("doc_kind").isin("guide", "api_doc"))
    articles = docs.select("doc_id", F.regexp_replace("source_path", r"/[^/]*$", "").alias("source"), F.col("source_path").alias("own_path"))
    changes = table(spark, d, "documents").where(F.col("doc_kind") == "changelog").select(F.col("source_path").alias("path"))
    return I.stale_articles(articles, changes)


def intent_impact(spark, d, seeds=graphs._seeds, depth: int = 1):
    hops = _graph(spark, d)[0]
    seeds = seeds(spark, d)
    reached = G.impact(hops, seeds, depth).select("id").unionByName(seeds)
    return I.intent_impact(reached, *(table(spark, d, t) for t in ("code_bindings", "work_units", "spec_nodes")))


NAMED = {
    "context_candidates": evidence,
    "context_projection": projection,
    "context_candidates_deep": lambda spark, d: evidence(spark, d, C.IMPACT_DEPTH),
    "context_projection_deep": lambda spark, d: projection(spark, d, C.IMPACT_DEPTH),
    "module_inventory": modules,
    "module_edges": module_edges,
    "text_ranking": text_ranking,
    "stale_articles": stale_articles,
    "intent_impact": intent_impact,
    "intent_impact_all": lambda spark, d: intent_impact(spark, d, graphs._asked, C.IMPACT_DEPTH),
    "test_obligations": lambda spark, d: I.test_obligations(specs.scenarios(documents._docs(spark, d))),
}


def queries() -> dict:
    return dict(NAMED)


_NAMES = C.intent(QUESTION).identifiers
_bare = lambda x: f"lower(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"


def _score(name: str) -> str:
    # names here are single camel-case words
    return f"CASE WHEN id = '{name}' THEN 1100 WHEN symbol = '{name}' THEN 1075 WHEN lower(id) = lower('{name}') OR lower(symbol) = lower('{name}') THEN 900 WHEN ends_with(symbol, '::{name}') THEN 850 WHEN {documents._SEG.replace('symbol', 'string_split(symbol, chr(58) || chr(58))[-1]')} = {documents._SEG.replace('symbol', chr(39) + name + chr(39))} THEN 550 WHEN contains({_bare('symbol')}, {_bare(chr(39) + name + chr(39))}) THEN 300 END"


_CAND = graphs._REC + f""", named AS (SELECT * FROM (SELECT id, greatest({', '.join(_score(n) for n in _NAMES)}, CASE WHEN file = 'src/lib.rs' THEN 1050 END) AS s FROM live) WHERE s IS NOT NULL),
sd AS (SELECT id FROM named WHERE s >= 550),
near AS (SELECT DISTINCT x AS id FROM (SELECT to_id AS x FROM hops WHERE from_id IN (SELECT id FROM sd) UNION ALL SELECT from_id FROM hops WHERE to_id IN (SELECT id FROM sd)) WHERE x NOT IN (SELECT id FROM sd)),
impls AS (SELECT DISTINCT from_id AS id FROM hops WHERE kind IN ('impls-trait', 'impl-for') AND to_id IN (SELECT id FROM sd)),
walk AS (SELECT id, 0 AS distance FROM sd UNION SELECT CASE WHEN h.kind = 'contains' THEN h.to_id ELSE h.from_id END, w.distance + CASE WHEN h.kind = 'contains' THEN 0 ELSE 1 END FROM walk w JOIN hops h ON (h.kind = 'contains' AND h.from_id = w.id) OR (h.kind IN {graphs._DEP} AND h.to_id = w.id AND w.distance < 1)),
c AS (SELECT id, 'named-symbol' AS class, s AS score, s >= 550 AS required, CASE WHEN s >= 550 THEN 'named' ELSE 'resembles' END AS reasons FROM named
  UNION ALL SELECT id, 'adjacent-structure', 600, false, 'adjacent' FROM near
  UNION ALL SELECT id, 'unique-implementation', 950, true, 'only implementation' FROM impls WHERE (SELECT count(*) FROM impls) = 1
  UNION ALL SELECT id, 'representative-implementation', 750, false, 'first of several' FROM impls WHERE (SELECT count(*) FROM impls) > 1 AND id = (SELECT min(id) FROM impls)
  UNION ALL SELECT id, 'off-spine-sibling', 350, false, 'sibling' FROM impls WHERE (SELECT count(*) FROM impls) > 1 AND id <> (SELECT min(id) FROM impls)
  UNION ALL SELECT id, 'impact-path', greatest(0, 900 - 75 * min(distance)), false, 'depends on it' FROM walk WHERE id NOT IN (SELECT id FROM sd) GROUP BY id)
"""


def sql() -> dict[str, str]:
    fixed = _fixed()
    deep = lambda name: fixed[name].replace("w.distance < 1", f"w.distance < {C.IMPACT_DEPTH}")
    return fixed | {"intent_impact_all": deep("intent_impact").replace(graphs._ONE_FILE, graphs._ASKED), "context_candidates_deep": deep("context_candidates"), "context_projection_deep": deep("context_projection")}


def _fixed() -> dict[str, str]:
    order = ", ".join(f"'{x}'" for x in C.CLASS_ORDER)
    return {
        "context_candidates": _CAND + "SELECT * FROM c",
        "context_projection": _CAND + f", z AS (SELECT c.*, list_position([{order}], class) AS place, coalesce(strlen(c.id) + strlen(symbol), 0) AS bytes FROM c LEFT JOIN live USING (id)), f AS (SELECT *, sum(bytes) OVER (ORDER BY required DESC, place, score DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM z WHERE required OR score >= 400), s AS (SELECT class, bytes, CASE WHEN required OR upto <= 8000 THEN 'kept' ELSE 'over budget' END AS state FROM f UNION ALL SELECT class, bytes, 'below threshold' FROM z WHERE NOT required AND score < 400) SELECT class, state, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY ALL",
        "module_inventory": graphs._BASE + "SELECT array_to_string(string_split(symbol, '::')[1:2], '::') AS module, kind, count(*) AS n, count(DISTINCT file) AS n_files FROM live GROUP BY ALL",
        "module_edges": graphs._BASE + ", p AS (SELECT id, array_to_string(string_split(symbol, '::')[1:2], '::') AS m FROM live) SELECT a.m AS from_module, b.m AS to_module, count(*) AS n FROM hops JOIN p a ON a.id = from_id JOIN p b ON b.id = to_id WHERE a.m <> b.m GROUP BY ALL",
        "text_ranking": "SELECT doc_id, score FROM (SELECT doc_id, " + " + ".join(f"coalesce((length(lower({c})) - length(replace(lower({c}), 'fingerprint', ''))) // 11, 0)" for c in ("text", "source", "doc_kind")) + " AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50",
        "stale_articles": "WITH a AS (SELECT doc_id, regexp_replace(source_path, '/[^/]*$', '') AS source, source_path AS own FROM documents WHERE source_path IS NOT NULL AND doc_kind IN ('guide', 'api_doc')), c AS (SELECT DISTINCT source_path AS path FROM documents WHERE doc_kind = 'changelog' AND source_path IS NOT NULL) SELECT doc_id, count(DISTINCT path) AS n_changes FROM a JOIN c ON starts_with(source || '/', path || '/') OR starts_with(path || '/', source || '/') WHERE own NOT IN (SELECT path FROM c) GROUP BY doc_id",
        "intent_impact": graphs._REC + f""", walk AS (SELECT id, 0 AS distance FROM seeds UNION SELECT CASE WHEN h.kind = 'contains' THEN h.to_id ELSE h.from_id END, w.distance + CASE WHEN h.kind = 'contains' THEN 0 ELSE 1 END FROM walk w JOIN hops h ON (h.kind = 'contains' AND h.from_id = w.id) OR (h.kind IN {graphs._DEP} AND h.to_id = w.id AND w.distance < 1)),
h AS (SELECT {clean('requirement_id', True)} AS requirement_id, count(DISTINCT {clean('node_id')}) AS n_nodes FROM code_bindings WHERE {clean('requirement_id')} IS NOT NULL AND {clean('node_id')} IN (SELECT id FROM walk) GROUP BY 1),
u AS (SELECT {clean('requirement_id', True)} AS requirement_id, count(DISTINCT {clean('id', True)}) AS n FROM work_units GROUP BY 1),
s AS (SELECT {clean('r', True)} AS requirement_id, count(DISTINCT {clean('id', True)}) AS n FROM (SELECT id, unnest(satisfies) AS r FROM spec_nodes) GROUP BY 1)
SELECT requirement_id, n_nodes, coalesce(u.n, 0) AS n_units, coalesce(s.n, 0) AS n_specs, CASE WHEN u.n IS NULL THEN 'no work unit' WHEN s.n IS NULL THEN 'no spec' END AS gap FROM h LEFT JOIN u USING (requirement_id) LEFT JOIN s USING (requirement_id)""",
        "test_obligations": documents._BASE + "SELECT doc_id, scenario, coalesce(selector, 'test_' || regexp_replace(regexp_replace(lower(scenario), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS selector, CASE WHEN selector IS NULL THEN 'candidate' ELSE 'bound' END AS state FROM scenarios",
    }
