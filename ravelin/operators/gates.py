"""Gates and summaries over results: critical scenarios, quality, retrieval, runs of arms.

A gate is a column, never an exception: what blocks it comes out as rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.evaluation import median_mad, precision, ratio


def critical_gate(scenarios: DataFrame, results: DataFrame, group: str, key: str, most: int = 5) -> DataFrame:
    """(group, n_critical, n_blocking, blocking, blocked): critical scenarios with a result other than pass or pending_review.

    ``scenarios`` has (group, key, critical), ``results`` (key, verdict); any
    such result of a key blocks.  ``blocking`` lists the first ``most`` keys.
    """
    bad = results.where(~F.coalesce(F.col("verdict").isin("pass", "pending_review"), F.lit(False))).select(key).distinct().withColumn("_bad", F.lit(1))
    rows = scenarios.where(F.coalesce(F.col("critical"), F.lit(False))).select(group, key).distinct().join(bad, key, "left")
    first = rows.where("_bad = 1").withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_r") <= most)
    names = first.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("blocking"))
    counts = rows.groupBy(group).agg(F.count("*").alias("n_critical"), F.count("_bad").alias("n_blocking"))
    return counts.join(names, group, "left").select(group, "n_critical", "n_blocking", F.coalesce("blocking", F.lit("")).alias("blocking"), (F.col("n_blocking") > 0).alias("blocked"))


def failure_summary(results: DataFrame, group: str, key: str, most: int = 3) -> DataFrame:
    """(group, total, non_passing, first): how many results of a group don't pass, and the first ``most`` of them as key:verdict."""
    counts = results.groupBy(group).agg(F.count("*").alias("total"), F.count(F.when(F.col("verdict") != "pass", 1)).alias("non_passing"))
    ranked = results.where(F.col("verdict") != "pass").withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key, "verdict"))).where(F.col("_r") <= most)
    names = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", F.col(key).cast("string"), "verdict").alias("t")))).alias("_l"))
    return counts.where("non_passing > 0").join(names, group, "left").select(group, "total", "non_passing", F.array_join(F.transform("_l", lambda x: x["t"]), ", ").alias("first"))


def quality_gate(quality: DataFrame, diagnostics: DataFrame, least: float) -> DataFrame:
    """(doc_id, overall, n_errors, passing): no diagnostic is an error and the score is at least ``least``."""
    errors = diagnostics.where(F.col("severity") == "error").groupBy("doc_id").agg(F.count("*").alias("n_errors"))
    rows = quality.select("doc_id", "overall").join(errors, "doc_id", "left").na.fill(0, ["n_errors"])
    return rows.withColumn("passing", (F.col("n_errors") == 0) & (F.col("overall") >= least))


def case_problems(cases: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """(key, problem) of an evaluation corpus: ids that are blank or given twice, lists that are empty or hold blank or repeated items."""
    blank = cases.where(F.coalesce(F.trim(key), F.lit("")) == "").select(F.lit("").alias(key), F.lit("blank id").alias("problem"))
    twice = cases.where(F.trim(key) != "").groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit("id given twice").alias("problem"))
    parts = [blank, twice]
    for c in lists:
        items = F.coalesce(F.col(c), F.array().cast("array<string>"))
        bad = F.when(F.size(items) == 0, f"no {c}").when(F.exists(items, lambda x: F.coalesce(F.trim(x), F.lit("")) == "") | (F.size(F.array_distinct(items)) < F.size(items)), f"blank or repeated {c}")
        parts.append(cases.where(F.trim(key) != "").select(key, bad.alias("problem")).where(F.col("problem").isNotNull()))
    return reduce(DataFrame.unionByName, parts).distinct()


def result_problems(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, problem): results of unknown cases, cases observed twice, cases without a result."""
    c, r = cases.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_c", F.lit(1)), results.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    problem = F.when(F.col("_c").isNull(), "unknown case").when(F.col("_n").isNull(), "no result").when(F.col("_n") > 1, "observed twice")
    return c.join(r, key, "full").select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def retrieval_scores(cases: DataFrame, key: str, expected: str, ranked: str, forbidden: str) -> DataFrame:
    """(key, n_returned, recall, reciprocal_rank, precision, forbidden_hits, passed) of each case.

    Arrays as sets but for the rank, which is that of the first expected item;
    null arrays are empty.  A case passes if everything expected and nothing
    forbidden was returned.
    """
    none = F.array().cast("array<string>")
    e, r, f = (F.coalesce(F.col(c), none) for c in (expected, ranked, forbidden))
    hit = F.size(F.array_intersect(e, r))
    n_expected, n_returned = F.size(F.array_distinct(e)), F.size(F.array_distinct(r))
    first = F.array_min(F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(e, x), i + 1)), lambda x: x.isNotNull()))
    bad = F.size(F.array_intersect(f, r))
    rank = F.when(n_expected == 0, F.lit(1.0)).otherwise(F.coalesce(1 / first, F.lit(0.0)))
    return cases.select(key, n_returned.alias("n_returned"), ratio(hit, n_expected).alias("recall"), rank.alias("reciprocal_rank"), precision(hit, n_returned, n_expected == 0).alias("precision"), bad.alias("forbidden_hits"), ((hit == n_expected) & (bad == 0)).alias("passed"))


def retrieval_summary(scores: DataFrame) -> DataFrame:
    """One row: cases, passed, failed, the means (0 without cases), the rate of forbidden items among returned ones, and the gate: nothing failed."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = scores.agg(F.count("*").alias("cases"), F.count(F.when(F.col("passed"), 1)).alias("passed"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mean_reciprocal_rank"), mean("precision").alias("precision"), F.coalesce(F.sum("forbidden_hits"), F.lit(0)).alias("_f"), F.coalesce(F.sum("n_returned"), F.lit(0)).alias("_r"))
    rate = F.when(F.col("_r") == 0, 0.0).otherwise(F.col("_f") / F.col("_r"))
    return out.select("cases", "passed", (F.col("cases") - F.col("passed")).alias("failed"), "recall", "mean_reciprocal_rank", "precision", rate.alias("forbidden_rate"), (F.col("cases") == F.col("passed")).alias("passing"))


def run_summary(runs: DataFrame, groups: list[str], metrics: list[str], graded: Column) -> DataFrame:
    """(groups, metric, runs, missing, samples, median, mad, n_ungraded, publishable): one row per metric.

    Null values are missing, not 0.  A summary may only be published if every
    run of the group is graded.
    """
    rows = runs.withColumn("_u", (~F.coalesce(graded, F.lit(False))).cast("int"))
    long = rows.select(*groups, "_u", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_m")).select(*groups, "_u", "_m.*")
    keys = [*groups, "metric"]
    counts = long.groupBy(*keys).agg(F.count("*").alias("runs"), F.count(F.when(F.col("v").isNull(), 1)).alias("missing"), F.sum("_u").alias("n_ungraded"))
    robust = median_mad(long, keys, "v")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    met = counts.alias("a").join(robust.alias("b"), same, "left")
    return met.select(*[F.col(f"a.{k}").alias(k) for k in keys], "runs", "missing", F.coalesce("samples", F.lit(0)).alias("samples"), "median", "mad", "n_ungraded", (F.col("n_ungraded") == 0).alias("publishable"))


def run_problems(runs: DataFrame) -> DataFrame:
    """(request_id, problem) of runs of a load test: what a receipt may not hold.

    ``runs``: request_id, mode, outcome, diagnostic, queue_wait_ms, service_ms,
    queued, active, outstanding (one row per request).
    """
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in ("queue_wait_ms", "service_ms", "queued", "active", "outstanding")])
    checks = [
        (F.col("mode").isNull(), "no mode"),
        (F.col("outcome").isNull(), "no outcome"),
        (F.col("service_ms").isNull() | F.col("queue_wait_ms").isNull(), "not measured"),
        (negative, "negative measurement"),
        (F.coalesce(F.col("outcome") == "success", F.lit(False)) & F.col("diagnostic").isNotNull(), "success with diagnostic"),
        (F.coalesce(F.col("outcome") != "success", F.lit(False)) & F.col("diagnostic").isNull(), "failure without diagnostic"),
        (F.coalesce(F.col("queued") + F.col("active") != F.col("outstanding"), F.lit(False)), "pool doesn't add up"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    return runs.select("request_id", F.explode(found).alias("problem"))


def compare_cases(runs: DataFrame, case: str, arm: str, metrics: list[str], reference: str, candidate: str) -> DataFrame:
    """(case, n_improved, n_tie, n_blocked, n_incomplete, state): a candidate arm against a reference over several metrics.

    Per metric the candidate's median is improved (below the reference's by
    more than its MAD), a tie (within it) or blocked; a metric that one arm
    has no samples of is incomplete.  A case is blocked by any blocked or
    incomplete metric, improved if all are, else a tie.
    """
    long = runs.select(case, arm, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_m")).select(case, arm, "_m.*")
    keys = [case, arm, "metric"]
    bands = median_mad(long.where(F.col(arm).isin(reference, candidate)), keys, "v")
    pick = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = bands.groupBy(case, "metric").agg(pick(reference, "median").alias("_r"), pick(reference, "mad").alias("_d"), pick(candidate, "median").alias("_c"))
    decision = F.when(F.col("_r").isNull() | F.col("_c").isNull(), "incomplete").when(F.col("_c") < F.col("_r") - F.col("_d"), "improved").when(F.col("_c") <= F.col("_r") + F.col("_d"), "tie").otherwise("blocked")
    count = lambda s: F.count(F.when(decision == s, 1))
    per = wide.groupBy(case).agg(count("improved").alias("n_improved"), count("tie").alias("n_tie"), count("blocked").alias("n_blocked"), (count("incomplete") + F.lit(len(metrics)) - F.count("*")).alias("n_incomplete"))
    state = F.when((F.col("n_blocked") > 0) | (F.col("n_incomplete") > 0), "blocked").when(F.col("n_improved") == len(metrics), "improved").otherwise("tie")
    return per.withColumn("state", state)
