"""Parquet tables of a data folder, and rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def earliest(df: DataFrame, key: str, columns: list[str], order: str = "arrived_at") -> DataFrame:
    """One row per non-null ``key``: the earliest by ``order``, with ``columns``.

    Rows without a time come last; ties go to the smallest content, so the
    result doesn't depend on the order of rows.  Redelivered copies are
    combined before the shuffle, so a key delivered very often is no hot group.
    """
    rest = [c for c in columns if c not in (key, order)]
    packed = F.struct(F.col(order).isNull().alias("_late"), F.col(order), *[F.col(c) for c in rest])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(packed).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns if c != key])
