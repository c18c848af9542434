"""Inventories and impact over requirements, code and texts: modules, their edges, ranked texts, stale articles, intent impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions.ids import clean_id, clean_requirement_id
from ravelin.operators.eager import eager_join


def module_of(symbol) -> object:
    """Package and module of a symbol: its first two parts."""
    return F.array_join(F.slice(F.split(symbol, "::"), 1, 2), "::")


def modules(nodes: DataFrame) -> DataFrame:
    """(module, kind, n, n_files) of all current nodes."""
    return nodes.groupBy(module_of("symbol").alias("module"), "kind").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))


def module_edges(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_module, to_module, n): hops between different modules, counted by two eager joins and never as single pairs."""
    place = nodes.select("id", module_of("symbol").alias("module"))
    by_target = hops.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    first = eager_join(by_target.select(F.col("from_id").alias("id"), "to_id", "n"), place, ["id"], ["to_id"], ["module"], ["n"]).select("to_id", F.col("module").alias("from_module"), F.col("sum_n").alias("n"))
    second = eager_join(first.select(F.col("to_id").alias("id"), "from_module", "n"), place, ["id"], ["from_module"], ["module"], ["n"])
    return second.where(F.col("from_module") != F.col("module")).select("from_module", F.col("module").alias("to_module"), F.col("sum_n").alias("n"))


def ranked_texts(docs: DataFrame, query: str, limit: int, columns: list[str]) -> DataFrame:
    """The ``limit`` documents with most non-overlapping occurrences of the query, in any case, over the columns; ties by doc_id."""
    q = query.lower()
    count = lambda c: F.coalesce((F.length(F.lower(F.col(c))) - F.length(F.replace(F.lower(F.col(c)), F.lit(q), F.lit("")))) / len(q), F.lit(0))
    total = sum((count(c) for c in columns[1:]), count(columns[0])).cast("bigint")
    return docs.select("doc_id", total.alias("score")).where(F.col("score") > 0).orderBy(F.desc("score"), "doc_id").limit(limit)


def stale_articles(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, n_changes): articles (doc_id, source, own_path) whose source lies at, below or above a changed path, the article itself unchanged.

    Paths meet on their leading parts, so the overlap is an equi-join.
    """
    heads = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda i: F.array_join(F.slice(F.split(p, "/"), F.lit(1), i), "/"))
    changed = changes.select("path").where(F.col("path").isNotNull()).distinct()
    below = articles.select("doc_id", F.explode(heads(F.col("source"))).alias("path")).join(changed, "path").select("doc_id", "path")
    above = changed.select("path", F.explode(heads(F.col("path"))).alias("source")).join(articles.select("doc_id", "source"), "source").select("doc_id", "path")
    touched = articles.select("doc_id", F.col("own_path").alias("path")).join(changed, "path", "left_semi").select("doc_id")
    hit = below.unionByName(above).distinct().join(touched, "doc_id", "left_anti")
    return hit.groupBy("doc_id").agg(F.count_distinct("path").alias("n_changes"))


def intent_impact(affected: DataFrame, bindings: DataFrame, units: DataFrame, specs: DataFrame) -> DataFrame:
    """(requirement_id, n_nodes, n_units, n_specs, gap): requirements bound to affected nodes (column id), with what is missing for each.

    ``gap`` names the first of: no work unit, no spec; null if there is none.
    """
    b = bindings.select("binding_id", clean_id("node_id").alias("id"), clean_requirement_id("requirement_id").alias("requirement_id")).where(F.col("requirement_id").isNotNull()).distinct()
    hit = b.join(affected.select("id").distinct(), "id", "left_semi").groupBy("requirement_id").agg(F.count_distinct("id").alias("n_nodes"))
    u = units.select(clean_requirement_id("requirement_id").alias("requirement_id"), clean_requirement_id("id").alias("u")).groupBy("requirement_id").agg(F.count_distinct("u").alias("n_units"))
    s = specs.select(clean_requirement_id("id").alias("s"), F.explode("satisfies").alias("_r")).select("s", clean_requirement_id("_r").alias("requirement_id")).groupBy("requirement_id").agg(F.count_distinct("s").alias("n_specs"))
    out = hit.join(u, "requirement_id", "left").join(s, "requirement_id", "left").na.fill(0)
    return out.withColumn("gap", F.when(F.col("n_units") == 0, "no work unit").when(F.col("n_specs") == 0, "no spec"))


def test_obligations(scenarios: DataFrame) -> DataFrame:
    """(doc_id, scenario, selector, state): each scenario's bound test, or a name made from the scenario's as a candidate."""
    made = T.slug("scenario", "test_")
    return scenarios.select("doc_id", "scenario", F.coalesce("selector", made).alias("selector"), F.when(F.col("selector").isNotNull(), "bound").otherwise("candidate").alias("state"))


def line_ratio(rows: DataFrame, most: float) -> DataFrame:
    """``rows`` with ratio = added / deleted (0 of nothing, infinite without deletions) and whether it is at most ``most``."""
    ratio = F.when((F.col("added") == 0) & (F.col("deleted") == 0), 0.0).when(F.col("deleted") == 0, float("inf")).otherwise(F.col("added") / F.col("deleted"))
    return rows.withColumn("ratio", ratio).withColumn("passing", ratio <= most)
