"""Waiting and service times of serving runs per mode and day, week and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.ids import clean_id, spelling
from ravelin.operators.quantiles import combine, percentiles, value_counts
from ravelin.sources.tables import earliest

QUANTILES = [0.5, 0.9, 0.95, 0.99]
DAY_MS = 86_400_000


def measurements(runs: DataFrame) -> DataFrame:
    """(serving_mode, day, metric, ms): each run once, from its earliest arrival; a null mode is a group of its own."""
    rows = runs.select(clean_id("request_id").alias("request_id"), "arrived_at", "started_at", spelling("serving_mode").alias("serving_mode"), F.col("measurements.queue_wait_ms").alias("queue_wait_ms"), F.col("measurements.service_ms").alias("service_ms"))
    once = earliest(rows, "request_id", ["request_id", "started_at", "serving_mode", "queue_wait_ms", "service_ms"])
    day = F.date_from_unix_date(F.floor(F.unix_micros("started_at") / F.lit(86_400_000_000)).cast("int"))
    both = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("ms")) for m in ("queue_wait_ms", "service_ms")])
    return once.select("serving_mode", day.alias("day"), F.explode(both).alias("_m")).select("serving_mode", "day", "_m.*")


def daily_states(runs: DataFrame, bits: int | None = None) -> DataFrame:
    """Combinable states (serving_mode, day, metric, value, n); a run without start has a null day."""
    return value_counts(measurements(runs), ["serving_mode", "day", "metric"], "ms", 0, DAY_MS, bits)


def wide(rows: DataFrame, keys: list[str], error: float) -> DataFrame:
    """One row per group: n, p50, p90, p95, p99 and the stated relative error of each."""
    at = lambda q: F.max(F.when(F.col("q") == F.lit(q), F.col("value")))
    return rows.groupBy(*keys).agg(F.max("total").alias("n"), *[at(q).alias(f"p{round(q * 100)}") for q in QUANTILES]).withColumn("relative_error", F.lit(float(error)))


def percentiles_per(runs: DataFrame, period: str = "day", bits: int | None = None) -> DataFrame:
    """Percentiles per mode, metric and period (day, week from Monday, month), from combined daily states."""
    return percentiles_of(daily_states(runs, bits), period, bits)


def percentiles_of(states: DataFrame, period: str, bits: int | None = None) -> DataFrame:
    """:func:`percentiles_per` from daily states, stored or not."""
    if period != "day":
        start = F.to_date(F.date_trunc(period, F.col("day").cast("timestamp_ntz")))
        states = combine(states.withColumn("day", start), ["serving_mode", "day", "metric"])
    keys = ["serving_mode", "day", "metric"]
    return wide(percentiles(states, keys, QUANTILES), keys, 0.0 if bits is None else 2.0 ** (1 - bits)).withColumnRenamed("day", period)
