"""Queries p6 to p8.  SQL can't express them; tests/llm checks them against brute force and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import leaks, packing, toxicity
from ravelin.sources.tables import table


def p6_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Where each text, or each piece of a text longer than a container, lies."""
    vocabulary = spark.conf.get("spark.ravelin.vocabulary", packing.VOCABULARY)
    return packing.pack(packing.token_counts(table(spark, d, "documents"), vocabulary))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each container's fill."""
    return packing.containers(p6_assignments(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    return p7_passages(spark, d).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The same with the length and place of the longest passage."""
    return leaks.passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents that it leaked into."""
    found = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return table(spark, d, "benchmark").select("item_id", "tier").distinct().join(found, "item_id", "left").select("item_id", "tier", F.coalesce("n", F.lit(0)).alias("n_docs"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score."""
    return toxicity.scores(table(spark, d, "documents"), table(spark, d, "labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents scored as abusive, hateful or sexual."""
    return p8_scores(spark, d).where("toxic").select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents per source."""
    return toxicity.rates(p8_scores(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (p6_assignments, p6_containers, p7_found, p7_passages, p7_items, p8_found, p8_scores, p8_rates)}


def sql() -> dict[str, str]:
    return {}
