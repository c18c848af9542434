"""Joins, set operations and windows on verdicts, references, runs and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.session import SALTS, salted_join, small


def unique_join(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the only right row of its key; null if there are none or several distinct ones."""
    one = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return left.join(one, key, "left")


def first_wins(results: DataFrame, key: str, order: list[str], all_keys: DataFrame, value: str = "verdict", missing: str = "skip") -> DataFrame:
    """(key, value): the first result of each key by ``order``; keys of ``all_keys`` without any get ``missing``."""
    packed = F.struct(*order, value)
    first = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(packed).alias("_f")).select(key, F.col(f"_f.{value}").alias(value))
    rest = all_keys.select(key).where(F.col(key).isNotNull()).distinct().join(first, key, "left_anti").withColumn(value, F.lit(missing))
    return first.unionByName(rest)


def coverage_matrix(items: DataFrame, tests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, test, verdict): items left-joined with tests (found, missing) and their first verdict, then verdicts without an item."""
    t = tests.select(key).distinct().withColumn("test", F.lit("found"))
    r = results.groupBy(key).agg(F.min_by("verdict", "seq").alias("verdict"))
    mine = items.select(key).distinct().join(t, key, "left").join(r, key, "left").select(key, F.coalesce("test", F.lit("missing")).alias("test"), "verdict")
    orphan = r.join(items.select(key).distinct(), key, "left_anti").select(key, F.lit(None).cast("string").alias("test"), "verdict")
    return mine.unionByName(orphan)


def boundary_verdicts(changes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, verdict) of changed paths against (pattern, category): denied beats allowed; unmatched is a failure only if something is allowed.

    Patterns are few by nature; their number is checked before they are sent
    to all tasks.  No patterns: no rows.
    """
    p = patterns.select(T.path_glob("pattern").alias("_re"), "category").distinct()
    lists = p.agg(F.sort_array(F.collect_set(F.when(F.col("category") == "allow", F.col("_re")))).alias("_allow"), F.sort_array(F.collect_set(F.when(F.col("category").isin("deny", "general"), F.col("_re")))).alias("_deny"))
    rows = changes.select("path").where(F.col("path").isNotNull()).distinct().withColumn("_one", F.lit(1)).join(small(lists.withColumn("_one", F.lit(1))), "_one")
    hit = lambda c: F.exists(c, lambda r: F.rlike(F.col("path"), r))
    rows = rows.where((F.size("_allow") > 0) | (F.size("_deny") > 0))
    return rows.select("path", F.when(hit("_deny"), "fail").when(hit("_allow"), "pass").when(F.size("_allow") > 0, "fail").otherwise("pass").alias("verdict"))


def conflicts(items: DataFrame) -> DataFrame:
    """(text, n_allow, n_deny): texts that some documents allow and others deny, from counts and not from pairs."""
    per = items.where(F.col("text").isNotNull()).groupBy("text").agg(F.count_distinct(F.when(F.col("category") == "allow", F.col("doc_id"))).alias("n_allow"), F.count_distinct(F.when(F.col("category") == "deny", F.col("doc_id"))).alias("n_deny"))
    return per.where((F.col("n_allow") > 0) & (F.col("n_deny") > 0))


def merge_checkpoint(results: DataFrame, checkpoint: DataFrame, key: str, incremental: bool = True) -> DataFrame:
    """(key, verdict, duration_ms, regression): incremental: an earlier pass stands and costs nothing; else pass to fail is marked."""
    old = checkpoint.groupBy(key).agg(F.max("verdict").alias("_old"))
    joined = results.join(old, key, "left")
    stands = F.coalesce(F.col("_old") == "pass", F.lit(False)) if incremental else F.lit(False)
    return joined.select(key, F.when(stands, "pass").otherwise(F.col("verdict")).alias("verdict"), F.when(stands, 0).otherwise(F.col("duration_ms")).cast("bigint").alias("duration_ms"), (F.lit(not incremental) & F.coalesce((F.col("_old") == "pass") & (F.col("verdict") == "fail"), F.lit(False))).alias("regression"))


def dependency_skips(results: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(id, verdict): skip if a prerequisite is missing or didn't pass, by the verdicts as they came in (one step, not transitive)."""
    verdicts = results.groupBy("id").agg(F.min("verdict").alias("_v"))
    need = dependencies.select("id", F.col("needs").alias("_need")).where(F.col("needs").isNotNull()).distinct()
    state = need.join(verdicts.select(F.col("id").alias("_need"), F.col("_v").alias("_nv")), "_need", "left")
    blocked = state.groupBy("id").agg(F.max((F.coalesce(F.col("_nv"), F.lit("none")) != "pass").cast("int")).alias("_b"))
    return verdicts.join(blocked, "id", "left").select("id", F.when(F.col("_b") == 1, "skip").otherwise(F.col("_v")).alias("verdict"))


def verdict_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per verdict and the pass rate, 0.0 for an empty group of a global count."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    out = results.groupBy(*keys).agg(F.count("*").alias("total"), *[count(v) for v in ("pass", "fail", "skip", "uncertain")])
    return out.withColumn("pass_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("pass") / F.col("total")))


def rollup(counts: DataFrame) -> DataFrame:
    """``verdict_counts`` with ``rollup``: any failure fails; nothing or anything undecided is a skip; else a pass."""
    return counts.withColumn("rollup", F.when(F.col("fail") > 0, "fail").when((F.col("total") == 0) | (F.col("pass") < F.col("total")), "skip").otherwise("pass"))


def liveness(items: DataFrame, rollups: DataFrame, key: str) -> DataFrame:
    """(key, liveness) of all items: violated by any failure, unproven without verdicts or with anything but passes, else honored."""
    per = rollups.groupBy(key).agg(F.max((F.col("rollup") == "fail").cast("int")).alias("_f"), F.min((F.col("rollup") == "pass").cast("int")).alias("_p"))
    joined = items.select(key).where(F.col(key).isNotNull()).distinct().join(per, key, "left")
    return joined.select(key, F.when(F.col("_f") == 1, "violated").when(F.coalesce("_p", F.lit(0)) == 0, "unproven").otherwise("honored").alias("liveness"))


def gate(counts: DataFrame, strict: bool = False) -> DataFrame:
    """``verdict_counts`` with ``passing``: something passed and nothing failed, was skipped or is uncertain."""
    undecided = F.col("total") - F.col("pass") - F.col("fail") - F.col("skip") - F.col("uncertain")
    return counts.withColumn("passing", (F.col("total") > 0) & (F.col("fail") == 0) & (F.col("skip") == 0) & (F.col("uncertain") == 0) & (~F.lit(strict) | (undecided == 0)))


def deltas(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ordinal and each value's difference from the row before of its key; null on the first."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select("*", F.row_number().over(w).alias("ordinal"), *[(F.col(v) - F.lag(v).over(w)).alias(f"d_{v}") for v in values])


def latest_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows of each key's latest run: equal to the greatest (order...) of the key."""
    run = F.struct(*order)
    last = rows.groupBy(key).agg(F.max(run).alias("_last"))
    return salted_join(rows, last, key, "inner", run).where(run == F.col("_last")).drop("_last")


def byte_budget(rows: DataFrame, group: str, order: str, bytes_: str, budget: int, required: str) -> DataFrame:
    """``rows`` with ``kept``: required ones always, others in ``order`` (unique in a group, not null) while they fit the budget with all before them.

    A null group is a group of its own; null bytes count nothing.  A row can
    only be kept if it fits within a SALTS-th of its group, too.  So sums run
    over parts of a group first; what is left of each part, up to its first
    row beyond the budget, is short and summed up per group.
    """
    salt = F.pmod(F.xxhash64(order), F.lit(SALTS))
    must, size = F.coalesce(F.col(required), F.lit(False)), F.coalesce(F.col(bytes_), F.lit(0))
    # a null group's number is 1, all others' 0, and its name is empty
    key = [F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g"), F.col(group).isNull().cast("int").alias("_z")]
    base = rows.where(must).groupBy(*key).agg(F.sum(size).alias("_base"))
    free = rows.where(~must).select(*key, F.col(order).alias("_o"), size.alias("_n"), salt.alias("_s"))
    upto = lambda *k: Window.partitionBy(*k).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    near = free.withColumn("_u", F.sum("_n").over(upto("_g", "_z", "_s"))).where(F.col("_u") - F.col("_n") <= budget)
    summed = near.withColumn("_u", F.sum("_n").over(upto("_g", "_z"))).join(base, ["_g", "_z"], "left")
    fit = summed.where(F.col("_u") + F.coalesce("_base", F.lit(0)) <= budget).select("_g", "_z", F.col("_o").alias("_order"), F.lit(True).alias("_fit"))
    met = rows.select("*", *key, F.col(order).alias("_order")).join(fit, ["_g", "_z", "_order"], "left")
    return met.select(*rows.columns, (must | F.coalesce("_fit", F.lit(False))).alias("kept"))


def page_after(rows: DataFrame, order: list[str], cursor: Column, size: int) -> DataFrame:
    """The ``size`` rows behind the cursor (a struct of the order columns): a filter and a top-k, no global numbering."""
    return rows.where(F.struct(*order) > cursor).orderBy(*order).limit(size)


def omissions(dropped: DataFrame) -> DataFrame:
    """(class, reason, n, top_score, top_id) of what was left out; the smallest id among equal scores."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "id"))
    return dropped.groupBy("class", "reason").agg(F.count("*").alias("n"), best.alias("_b")).select("class", "reason", "n", (-F.col("_b.s")).alias("top_score"), F.col("_b.id").alias("top_id"))


def merge_candidates(rows: DataFrame) -> DataFrame:
    """One row per id: highest score, required if any is, the distinct reasons in order."""
    return rows.groupBy("id").agg(F.max("score").alias("score"), F.max("required").alias("required"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def append_unique(parts: list[DataFrame], key: str) -> DataFrame:
    """Keys of several inputs, each once, with the number of the first input that has it."""
    out = None
    for i, p in enumerate(parts):
        q = p.select(key).where(F.col(key).isNotNull()).withColumn("part", F.lit(i))
        out = q if out is None else out.unionByName(q)
    return out.groupBy(key).agg(F.min("part").alias("part"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(rows: DataFrame, columns: list[str], groups: list[str] = ()) -> DataFrame:
    """(groups, fingerprint): SHA-256 over the sorted digests of a group's rows, nulls told apart from empty text.

    Digests are put together in 4,096 buckets by their first digits before
    the buckets are, so that no task sorts all rows of a group.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    hashed = rows.select(*groups, row.alias("_h"))
    parts = hashed.groupBy(*groups, F.substring("_h", 1, 3).alias("_p")).agg(joined("_h").alias("_d"))
    return parts.groupBy(*groups).agg(joined(F.concat("_p", "_d")).alias("fingerprint"))


def first_hit_rank(rows: DataFrame, case: str, order: str, expected: str) -> DataFrame:
    """(case, rank, reciprocal): rank of the first expected row by ``order``, null and 0.0 without one.

    The rank is counted, not numbered: rows up to the first hit.
    """
    first = rows.groupBy(case).agg(F.min(F.when(F.col(expected), F.col(order))).alias("_first"))
    before = salted_join(rows, first, case, "inner", F.col(order)).where(F.col(order) <= F.col("_first")).groupBy(case).agg(F.count("*").alias("rank"))
    return first.select(case).join(before, case, "left").withColumn("reciprocal", F.coalesce(1 / F.col("rank"), F.lit(0.0)))


def pattern_counts(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, n_lines, n_docs): lines (doc_id, line) that contain each literal; 0 for patterns that none does."""
    found = texts.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("line", F.lit(p)), F.lit(p)) for p in patterns]))).alias("pattern"))
    seen = found.groupBy("pattern").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))
    every = texts.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    return every.join(seen, "pattern", "left").na.fill(0, ["n_lines", "n_docs"])
