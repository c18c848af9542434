"""Scoring of retrieval, robust summaries of metrics, comparison of arms, run plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 1.0 where d is 0."""
    return F.when(d == 0, F.lit(1.0)).otherwise(n / d)


def precision(hits: Column, returned: Column, expected_empty: Column) -> Column:
    """hits / returned; of nothing returned 1.0 if nothing was expected, else 0.0."""
    return F.when(returned == 0, F.when(expected_empty, 1.0).otherwise(0.0)).otherwise(hits / returned)


def mean(x: str) -> Column:
    """Mean, 0.0 of nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def set_scores(rows: DataFrame, expected: str, observed: str) -> DataFrame:
    """``rows`` with n_hit, n_missing, n_extra, recall and precision of two arrays as sets; null arrays are empty."""
    e, o = F.coalesce(expected, F.array().cast("array<string>")), F.coalesce(observed, F.array().cast("array<string>"))
    hit = F.size(F.array_intersect(e, o))
    ne, no = F.size(F.array_distinct(e)), F.size(F.array_distinct(o))
    return rows.select("*", hit.alias("n_hit"), (ne - hit).alias("n_missing"), (no - hit).alias("n_extra"), ratio(hit, ne).alias("recall"), precision(hit, no, ne == 0).alias("precision"))


def reciprocal_rank(ranked: DataFrame, case: str, rank: str, expected: Column) -> DataFrame:
    """(case, rr): 1 / the best rank of an expected row, 0.0 without one."""
    return ranked.groupBy(case).agg(F.coalesce(1 / F.min(F.when(expected, F.col(rank))), F.lit(0.0)).alias("rr"))


def median_mad(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, samples, median, mad): median (mean of the middle two) and median absolute deviation, from value counts.

    Both are exact and computed on counts per distinct value, so a group with
    most rows is no single task's list; nulls are no samples.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    first = _weighted_median(counts, groups, "v").withColumnRenamed("median", "_m")
    away = _same_group(counts, first, groups).select(*[F.col(f"a.{g}").alias(g) for g in groups], F.abs(F.col("a.v") - F.col("b._m")).alias("v"), F.col("a.n").alias("n"))
    second = _weighted_median(away.groupBy(*groups, "v").agg(F.sum("n").alias("n")), groups, "v")
    joined = _same_group(first, second, groups)
    return joined.select(*[F.col(f"a.{g}").alias(g) for g in groups], F.col("a.samples").alias("samples"), F.col("a._m").alias("median"), F.col("b.median").alias("mad"))


def _same_group(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of a (left) and b (right) of the same group, null being a group."""
    on = reduce(lambda x, y: x & y, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups])
    return left.alias("a").join(right.alias("b"), on)


def _weighted_median(counts: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Median of counted values: ranges of values first, then only the ranges that hold the middle.

    A range is 1/64 of a power of two, so a group has some 130,000 at most;
    their running sums are the offsets, and only the values of one or two
    ranges of a group are sorted.
    """
    v, far = F.col(value), F.lit(1 << 20)
    part = F.when(v > 0, far + F.floor(F.log2(v) * 64)).when(v < 0, -far - F.floor(F.log2(-v) * 64)).otherwise(F.lit(0)).cast("long")
    ranged = counts.withColumn("_p", part)
    totals = ranged.groupBy(*groups, "_p").agg(F.sum("n").alias("_in"))
    upto = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.withColumn("_end", F.sum("_in").over(upto)).withColumn("samples", F.sum("_in").over(Window.partitionBy(*groups)))
    low, high = F.floor((F.col("samples") + 1) / 2), F.floor((F.col("samples") + 2) / 2)
    held = offsets.where((F.col("_end") >= low) & (F.col("_end") - F.col("_in") < high)).withColumn("_start", F.col("_end") - F.col("_in"))
    inside = _same_group(ranged, held, [*groups, "_p"]).select(*[F.col(f"a.{g}").alias(g) for g in groups], F.col("a._p").alias("_p"), F.col(f"a.{value}").alias(value), F.col("a.n").alias("n"), F.col("b.samples").alias("samples"), F.col("b._start").alias("_start"))
    within = Window.partitionBy(*groups, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = inside.withColumn("_upto", F.col("_start") + F.sum("n").over(within))
    at = lambda r: F.min(F.when(F.col("_upto") >= r, F.col(value)))
    return run.groupBy(*groups).agg(F.max("samples").alias("samples"), ((at(low) + at(high)) / 2).alias("median"))


def compare_arms(summary: DataFrame, keys: list[str], arm: str, reference: str, candidate: str) -> DataFrame:
    """(keys, reference, candidate, decision) of median/MAD rows of two arms: improved if clearly lower, tie within a MAD, else blocked; incomplete without both."""
    pick = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = summary.groupBy(*keys).agg(pick(reference, "median").alias("reference"), pick(reference, "mad").alias("_mad"), pick(candidate, "median").alias("candidate"))
    decision = F.when(F.col("reference").isNull() | F.col("candidate").isNull(), "incomplete").when(F.col("candidate") < F.col("reference") - F.col("_mad"), "improved").when(F.col("candidate") <= F.col("reference") + F.col("_mad"), "tie").otherwise("blocked")
    return wide.select(*keys, "reference", "candidate", decision.alias("decision"))


def run_plan(cases: DataFrame, arms: list[str], trials: int) -> DataFrame:
    """(case_id, arm, trial, run_id): every case with every arm and trial; the id is a digest of the three."""
    grid = cases.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")).select("case_id", "arm", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return grid.withColumn("run_id", F.sha2(F.concat_ws("\x1f", "case_id", "arm", F.col("trial").cast("string")), 256))


def plan_gaps(plan: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): planned runs without a receipt, receipts that weren't planned, and those given twice."""
    p = plan.select(*keys).distinct().withColumn("_p", F.lit(1))
    r = receipts.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = p.join(r, keys, "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_p").isNull(), "unplanned").when(F.col("_n") > 1, "duplicate")
    return joined.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def parity(runs: DataFrame, group: str, mode: str, result: str) -> DataFrame:
    """(group, n_modes, n_results, equal): whether all modes of a group gave one result."""
    per = runs.groupBy(group).agg(F.count_distinct(mode).alias("n_modes"), F.count_distinct(result).alias("n_results"))
    return per.withColumn("equal", F.col("n_results") == 1)
