"""Requirements as a graph, work units, coverage by specs, typed edges, status ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions.ids import clean_requirement_id


def current_requirements(requirements: DataFrame) -> DataFrame:
    """Per id its latest row, unless deleted; ids evened out, also within dependencies and children (each once, sorted)."""
    ids = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean_requirement_id), lambda x: x.isNotNull())))
    columns = [F.col("title"), F.col("status"), ids("dependencies").alias("dependencies"), ids("children").alias("children"), F.col("scenario_count"), F.size(F.filter(F.coalesce("open_questions", F.array().cast("array<string>")), lambda q: T.strip(q) != "")).alias("n_questions"), F.col("deleted_at")]
    packed = F.struct(F.coalesce(F.unix_micros("arrived_at"), F.lit(0)).alias("_t"), F.struct(*columns).alias("_v"))
    last = requirements.select(clean_requirement_id("id").alias("id"), packed.alias("_p")).where(F.col("id").isNotNull()).groupBy("id").agg(F.max("_p").alias("_m"))
    return last.select("id", "_m._v.*").where(F.col("deleted_at").isNull()).drop("deleted_at")


def graph_problems(requirements: DataFrame) -> DataFrame:
    """(id, problem, other): dangling dependencies and children, leaves without scenarios, open questions, several parents."""
    ids = requirements.select(F.col("id").alias("other"))
    refs = lambda c, name: requirements.select("id", F.explode(c).alias("other")).join(ids, "other", "left_anti").select("id", F.lit(name).alias("problem"), "other")
    none = F.lit(None).cast("string")
    leaf = requirements.where((F.size("children") == 0) & (F.coalesce("scenario_count", F.lit(0)) == 0)).select("id", F.lit("leaf without scenario").alias("problem"), none.alias("other"))
    asked = requirements.where("n_questions > 0").select("id", F.lit("open questions").alias("problem"), none.alias("other"))
    parents = requirements.select(F.col("id").alias("p"), F.explode("children").alias("id")).groupBy("id").agg(F.count_distinct("p").alias("n")).where("n > 1").select("id", F.lit("several parents").alias("problem"), none.alias("other"))
    return refs("dependencies", "dangling dependency").unionByName(refs("children", "dangling child")).unionByName(leaf).unionByName(asked).unionByName(parents)


def work_units(requirements: DataFrame) -> DataFrame:
    """(id, mode, status): what is to be done for each requirement; those not accepted are informational."""
    scen, kids = F.coalesce("scenario_count", F.lit(0)), F.size("children")
    mode = F.when(F.col("n_questions") > 0, "blocked_questions").when((kids > 0) & (scen > 0), "parent_scenario").when(kids > 0, "grouping_only").when(scen > 0, "leaf_full").otherwise("missing_scenarios")
    ready = mode.isin("leaf_full", "parent_scenario")
    status = F.when(~F.coalesce(F.col("status") == "accepted", F.lit(False)), "informational").when(ready, "ready").otherwise("blocked")
    return requirements.select("id", mode.alias("mode"), status.alias("status"))


def spec_coverage(specs: DataFrame) -> DataFrame:
    """(requirement_id, n_specs, spec_ids): the distinct specs that satisfy each requirement id."""
    pairs = specs.select(clean_requirement_id("id").alias("spec"), F.explode("satisfies").alias("_r")).select("spec", clean_requirement_id("_r").alias("requirement_id"))
    pairs = pairs.where(F.col("requirement_id").startswith("REQ-") & F.col("spec").isNotNull())
    return pairs.groupBy("requirement_id").agg(F.count_distinct("spec").alias("n_specs"), F.array_sort(F.collect_set("spec")).alias("spec_ids"))


def status_ladder(requirements: DataFrame, satisfied: DataFrame, ready: DataFrame) -> DataFrame:
    """(id, rung) from the specs that satisfy a requirement (id, tier, verdict; tier: active, staged or archived).

    archived with an archived spec; verified if all its active specs pass,
    active with any; ready as a work unit; planned with a staged spec; else
    unplanned.
    """
    has = lambda t: F.max((F.col("tier") == t).cast("int"))
    tiers = satisfied.where(F.col("id").isNotNull()).groupBy("id").agg(has("archived").alias("_z"), has("active").alias("_a"), has("staged").alias("_s"), F.min(F.when(F.col("tier") == "active", F.coalesce(F.col("verdict") == "pass", F.lit(False)).cast("int"))).alias("_p"))
    rows = requirements.select("id").join(tiers, "id", "left").join(ready.select("id").distinct().withColumn("_r", F.lit(1)), "id", "left")
    rung = F.when(F.col("_z") == 1, "archived").when((F.col("_a") == 1) & (F.col("_p") == 1), "verified").when(F.col("_a") == 1, "active").when(F.col("_r") == 1, "ready").when(F.col("_s") == 1, "planned").otherwise("unplanned")
    return rows.select("id", rung.alias("rung"))


def plan_edges(requirements: DataFrame, units: DataFrame, specs: DataFrame) -> DataFrame:
    """(from_id, to_id, kind): child, dependency, work_unit and satisfies edges, each once."""
    child = requirements.select(F.col("id").alias("from_id"), F.explode("children").alias("to_id"), F.lit("child").alias("kind"))
    dependency = requirements.select(F.explode("dependencies").alias("from_id"), F.col("id").alias("to_id"), F.lit("dependency").alias("kind"))
    unit = units.select(clean_requirement_id("requirement_id").alias("from_id"), clean_requirement_id("id").alias("to_id"), F.lit("work_unit").alias("kind"))
    satisfies = specs.select(clean_requirement_id("id").alias("from_id"), F.explode("satisfies").alias("_t")).select("from_id", clean_requirement_id("_t").alias("to_id"), F.lit("satisfies").alias("kind"))
    every = child.unionByName(dependency).unionByName(unit).unionByName(satisfies)
    return every.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).distinct()


def transitions(requested: DataFrame) -> DataFrame:
    """(id, status, to, legal): whether a change of status is one of the legal ones."""
    legal = [(None, "proposed"), (None, "accepted"), ("proposed", "accepted"), ("proposed", "rejected"), ("accepted", "deprecated")]
    ok = F.lit(False)
    for a, b in legal:
        ok = ok | (F.col("status").eqNullSafe(F.lit(a)) & (F.col("to") == b))
    return requested.select("id", "status", "to", ok.alias("legal"))
