"""References to keys that don't exist: signed counts from change deltas.

Every row of a target table is a change of +1 in the month of its arrival and
of -1 in the month of its deletion.  Every reference is a change of the
reference count of its key in its month.  Both kinds are added up per (target
table, key, month) before any key is brought together, so a key that a third of
all references name is one short row per map task.  A running sum over a key's
few months gives the number of rows that are there at the end of each; a key
with references in a month and none there at its end is an orphan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.ids import clean_id, clean_requirement_id, leading_requirement_id
from ravelin.session import HOT_SHARE, cut, salted_join

REFERENCE_COLUMNS = ["src_table", "src_id", "field", "target", "ref_id", "period"]


def month(c) -> object:
    """The UTC month YYYY-MM of a timestamp (the session's time zone is not used)."""
    micros = F.unix_micros(F.col(c) if isinstance(c, str) else c)
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM")


def references(rows: DataFrame, table: str, source_id: str, field: str, target: str, array: bool = False, requirement: bool = True, prose: bool = False) -> DataFrame:
    """(src_table, src_id, field, target, ref_id, period) of one reference column, each once.

    Null and blank entries are none; a row without recorded_at has no period
    and gives none.  ``prose``: an entry is a reference only if it begins with
    a requirement id.
    """
    entry = F.explode(F.col(field)) if array else F.col(field)
    out = rows.select(F.lit(table).alias("src_table"), F.col(source_id).cast("string").alias("src_id"), F.lit(field).alias("field"), F.lit(target).alias("target"), entry.alias("_entry"), month("recorded_at").alias("period"))
    key = leading_requirement_id("_entry") if prose else clean_requirement_id("_entry") if requirement else clean_id("_entry")
    return out.withColumn("ref_id", key).where(F.col("ref_id").isNotNull() & F.col("period").isNotNull()).select(*REFERENCE_COLUMNS).distinct()


def existence_deltas(rows: DataFrame, target: str, requirement: bool, deletions: bool = True) -> DataFrame:
    """(target, ref_id, period, there): +1 in the month a row arrives, -1 in the month it is deleted.

    A row deleted before it arrived is never there; a row without arrival neither.
    """
    key = clean_requirement_id("id") if requirement else clean_id("id")
    gone = F.greatest("arrived_at", "deleted_at") if deletions else F.lit(None).cast("timestamp")
    gone = F.when(F.col("deleted_at").isNotNull(), gone) if deletions else gone
    change = lambda at, sign: F.struct(month(at).alias("period"), F.lit(sign).cast("long").alias("there"))
    changes = F.array(change(F.col("arrived_at"), 1), change(gone, -1))
    out = rows.where(F.col("arrived_at").isNotNull()).select(F.lit(target).alias("target"), key.alias("ref_id"), F.explode(changes).alias("_c")).select("target", "ref_id", "_c.*")
    return out.where(F.col("ref_id").isNotNull() & F.col("period").isNotNull())


def reference_state(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """The maintained state (target, ref_id, period, refs, there): signed changes of both counts, added up per key and month."""
    counted = refs.select("target", "ref_id", "period", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("there"))
    changed = deltas.select("target", "ref_id", "period", F.lit(0).cast("long").alias("refs"), "there")
    return _summed(counted.unionByName(changed))


def _summed(states: DataFrame) -> DataFrame:
    return states.groupBy("target", "ref_id", "period").agg(F.sum("refs").alias("refs"), F.sum("there").alias("there"))


def maintained(state: DataFrame, known: DataFrame, refs: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, known references) after a delivery: only the new rows are counted and added to what is stored.

    ``known`` holds the references counted so far (REFERENCE_COLUMNS), so that
    a redelivered one counts once; existence changes are per delivered row.
    """
    new = refs.join(known, REFERENCE_COLUMNS, "left_anti")
    return _summed(state.unionByName(reference_state(new, deltas))), known.unionByName(new)


def report(state: DataFrame) -> DataFrame:
    """(target, ref_id, period, n_refs, there) from a state: every referenced key at the end of each month that names it."""
    running = Window.partitionBy("target", "ref_id").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return state.withColumn("there", F.sum("there").over(running)).where(F.col("refs") > 0).withColumnRenamed("refs", "n_refs")


def orphan_states(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """:func:`report` of references and existence changes that were never stored."""
    return report(reference_state(refs, deltas))


def orphans(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose key has no row of its target at the end of their period."""
    states = cut(orphan_states(refs, deltas).where(F.col("there") <= 0))
    key = F.concat_ws("\x1f", "target", "ref_id", "period")
    total = states.agg(F.sum("n_refs")).first()[0] or 0
    hot = [r["k"] for r in states.where(F.col("n_refs") * HOT_SHARE >= total).select(key.alias("k")).collect()]  # HOT_SHARE at most
    return salted_join(refs.withColumn("_key", key), states.select(key.alias("_key")), "_key", "left_semi", F.struct("src_table", "src_id"), hot).drop("_key")


def all_references(work_units: DataFrame, spec_nodes: DataFrame, code_bindings: DataFrame) -> DataFrame:
    """The references of the four fields; redelivered rows count once."""
    parts = [
        references(work_units, "work_units", "id", "requirement_id", "requirements"),
        references(work_units, "work_units", "id", "blocked_by", "requirements", array=True, prose=True),
        references(spec_nodes, "spec_nodes", "id", "satisfies", "requirements", array=True),
        references(code_bindings, "code_bindings", "binding_id", "node_id", "nodes", requirement=False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_existence(requirements: DataFrame, nodes: DataFrame, shared_nodes: DataFrame) -> DataFrame:
    """The existence changes of both targets; nodes and shared_nodes are one target."""
    out = existence_deltas(requirements, "requirements", True)
    return out.unionByName(existence_deltas(nodes, "nodes", False)).unionByName(existence_deltas(shared_nodes, "nodes", False, deletions=False))


def orphan_counts(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """(src_table, field, period, n_refs, n_orphans), from the states alone: sources are counted per key first."""
    per_key = refs.groupBy("src_table", "field", "target", "ref_id", "period").agg(F.count("*").alias("n"))
    states = orphan_states(refs, deltas).select("target", "ref_id", "period", (F.col("there") <= 0).alias("_orphan"))
    joined = per_key.join(states, ["target", "ref_id", "period"])
    return joined.groupBy("src_table", "field", "period").agg(F.sum("n").alias("n_refs"), F.sum(F.when(F.col("_orphan"), F.col("n")).otherwise(0)).alias("n_orphans"))
