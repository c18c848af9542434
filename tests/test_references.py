from datetime import datetime

from pyspark.sql import functions as F

from ravelin.operators import references as R


def at(*x):
    return datetime(*x)


def test_orphans_by_period(spark):
    rows = [("w1", " req-a-0000001\t", at(2026, 1, 31, 23, 59)), ("w1", " req-a-0000001\t", at(2026, 1, 31, 23, 59)), ("w2", "REQ-A-0000001", at(2026, 2, 1)), ("w3", "REQ-A-0000001", at(2026, 3, 5)), ("w4", None, at(2026, 1, 1)), ("w5", "  ", at(2026, 1, 1)), ("w6", "REQ-A-0000002", None), ("w7", "REQ-A-0000009", at(2026, 1, 1))]
    units = spark.createDataFrame(rows, "id string, requirement_id string, recorded_at timestamp")
    target = spark.createDataFrame([("REQ-A-0000001 ", at(2026, 2, 10), at(2026, 3, 1)), ("req-a-0000001", at(2026, 2, 20), at(2026, 2, 11)), ("REQ-A-0000001", None, None)], "id string, arrived_at timestamp, deleted_at timestamp")
    refs = R.references(units, "work_units", "id", "requirement_id", "requirements")
    deltas = R.existence_deltas(target, "requirements", True)
    got = {(r["src_id"], r["ref_id"], r["period"]) for r in R.orphans(refs, deltas).collect()}
    # there at the end of February only: it arrives on the 10th and is gone with March
    assert got == {("w1", "REQ-A-0000001", "2026-01"), ("w3", "REQ-A-0000001", "2026-03"), ("w7", "REQ-A-0000009", "2026-01")}
    counts = {r["period"]: (r["n_refs"], r["n_orphans"]) for r in R.orphan_counts(refs, deltas).collect()}
    assert counts == {"2026-01": (2, 2), "2026-02": (1, 0), "2026-03": (1, 1)}
    assert R.orphans(refs.limit(0), deltas).collect() == []
    assert R.orphans(refs, deltas.limit(0)).count() == 4


def test_references_in_prose(spark):
    rows = [("w", ["REQ-AB-0000001: why?", "see REQ-AB-0000002", " req-ab-0000003 (x)", None, "", "REQ-AB-00000045", "REQ-AB-000001"], at(2026, 1, 1))]
    df = spark.createDataFrame(rows, "id string, blocked_by array<string>, recorded_at timestamp")
    got = {r["ref_id"] for r in R.references(df, "t", "id", "blocked_by", "r", array=True, prose=True).collect()}
    assert got == {"REQ-AB-0000001", "REQ-AB-0000003"}


def test_hot_reference_is_split(spark):
    refs = spark.range(30_000).select(F.lit("t").alias("src_table"), F.col("id").cast("string").alias("src_id"), F.lit("f").alias("field"), F.lit("r").alias("target"), F.lit("gone").alias("ref_id"), F.lit("2026-01").alias("period"))
    deltas = spark.createDataFrame([], "target string, ref_id string, period string, there bigint")
    assert R.orphans(refs, deltas).count() == 30_000


def test_a_delivery_added_to_the_state_is_the_whole(spark):
    """Late existence, deletion and redelivered references, counted in two deliveries and at once."""
    columns = "src_table string, src_id string, field string, target string, ref_id string, period string"
    early = [("w", "1", "f", "t", "A", "2026-01"), ("w", "2", "f", "t", "A", "2026-02"), ("w", "3", "f", "t", "B", "2026-02")]
    late = [("w", "1", "f", "t", "A", "2026-01"), ("w", "4", "f", "t", "B", "2026-03"), ("w", "5", "f", "t", "C", "2026-03")]
    refs = [spark.createDataFrame(x, columns) for x in (early, late)]
    deltas = [spark.createDataFrame(x, "target string, ref_id string, period string, there bigint") for x in ([("t", "A", "2026-02", 1), ("t", "B", "2026-01", 1)], [("t", "B", "2026-03", -1), ("t", "C", "2026-02", 1)])]
    state, known = R.maintained(R.reference_state(refs[0], deltas[0]), refs[0], refs[1], deltas[1])
    whole = R.orphan_states(refs[0].unionByName(refs[1]).distinct(), deltas[0].unionByName(deltas[1]))
    assert {tuple(r) for r in R.report(state).collect()} == {tuple(r) for r in whole.select(*R.report(state).columns).collect()}
    assert known.count() == 5
    assert {(r["ref_id"], r["period"]) for r in R.report(state).where("there <= 0").collect()} == {("A", "2026-01"), ("B", "2026-03")}
