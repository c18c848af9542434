"""Percentiles from combinable states: counts per group and value, ranges of values, running sums.

A state is the number of rows per (group, value).  States of days, partitions
or folders are combined by adding counts up, so no value is ever lost and the
rank error is 0; the value error is stated by the caller's resolution (below).
To find the values at the target ranks, the values of a group are cut into
ranges, the ranges' totals give each range its offset (a running sum over a
bounded number of ranges), and only the ranges that hold a target rank are
summed up value by value.  No task ever holds a group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values are cut into ranges of this many (a power of two).
RANGE = 1024


def resolution(value: Column, bits: int | None) -> Column:
    """``value`` (a long >= 0) rounded down to its ``bits`` leading binary digits; None: unchanged.

    A result v then stands for a value in [v, v * (1 + 2**(1 - bits))): at
    most 2**(bits - 1) values remain per power of two, so a state stays
    small however many distinct values there are.
    """
    if bits is None:
        return value
    low = F.greatest(F.length(F.bin(value)) - F.lit(bits), F.lit(0))
    step = F.pow(F.lit(2.0), low).cast("long")
    return F.floor(value / step).cast("long") * step


def value_counts(rows: DataFrame, groups: list[str], value: str, low: int, high: int, bits: int | None = None) -> DataFrame:
    """The state: (groups, value, n).  Nulls and values outside [low, high] are no measurements; null groups are groups."""
    v = F.col(value).cast("long")
    return rows.where(v.between(low, high)).groupBy(*groups, resolution(v, bits).alias("value")).agg(F.count("*").alias("n"))


def combine(state: DataFrame, groups: list[str]) -> DataFrame:
    """States of several days or partitions as one state of coarser ``groups``."""
    return state.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def store(state: DataFrame, path: str, part: str) -> None:
    """Writes a state as one part of a stored table; the same part written again replaces itself."""
    state.write.mode("overwrite").parquet(f"{path}/part={part}")


def stored(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """All parts of a stored table as one state."""
    return combine(spark.read.parquet(path), groups)


def percentiles(state: DataFrame, groups: list[str], quantiles: list[float]) -> DataFrame:
    """(groups, q, total, value): the smallest value with at least ceil(q * total) values up to it.

    A group without values has no row.
    """
    keys = list(groups)
    ranged = state.withColumn("_range", F.floor(F.col("value") / RANGE).cast("long"))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_in_range"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    offsets = totals.withColumn("_upto", F.sum("_in_range").over(upto)).withColumn("total", F.sum("_in_range").over(whole))
    targets = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(float(q)) * F.col("total"), 6))).cast("long").alias("_rank")) for q in quantiles])
    held = F.filter(targets, lambda t: (t["_rank"] <= F.col("_upto")) & (t["_rank"] > F.col("_upto") - F.col("_in_range")))
    wanted = offsets.withColumn("_targets", held).where(F.size("_targets") > 0).select(*keys, "_range", "total", "_targets", (F.col("_upto") - F.col("_in_range")).alias("_offset"))
    same = None
    a, b = ranged.alias("a"), wanted.alias("b")
    for k in [*keys, "_range"]:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = c if same is None else same & c
    inside = a.join(b, same).select(*[F.col(f"a.{k}").alias(k) for k in [*keys, "_range"]], "value", "n", "total", "_targets", "_offset")
    run = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = inside.withColumn("_end", F.col("_offset") + F.sum("n").over(run))
    hit = F.filter("_targets", lambda t: (t["_rank"] <= F.col("_end")) & (t["_rank"] > F.col("_end") - F.col("n")))
    return summed.select(*keys, "total", "value", F.explode(hit).alias("_t")).select(*keys, F.col("_t.q").alias("q"), "total", "value")
