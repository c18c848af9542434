import math
import random

from ravelin.operators import quantiles as Q
from ravelin.operators import serving


def brute(values, q):
    return sorted(values)[max(1, math.ceil(round(q * len(values), 6))) - 1]


def test_percentiles_equal_brute_force_and_combine(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0, 5, rng.randrange(86_400_000), rng.randrange(3000)])) for g in ["a"] * 2000 + [None] * 50 + ["b"]] + [("a", None), ("a", -1), ("a", 86_400_001)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    parts = [Q.value_counts(p, ["g"], "v", 0, 86_400_000) for p in df.randomSplit([0.5, 0.5], 1)]
    state = Q.combine(parts[0].unionByName(parts[1]), ["g"])
    got = {(r["g"], r["q"]): (r["total"], r["value"]) for r in Q.percentiles(state, ["g"], serving.QUANTILES).collect()}
    for g in ("a", None, "b"):
        own = [v for h, v in rows if h == g and v is not None and 0 <= v <= 86_400_000]
        for q in serving.QUANTILES:
            assert got[g, q] == (len(own), brute(own, q))
    assert Q.percentiles(state.limit(0), ["g"], [0.5]).collect() == []


def test_bounded_error(spark):
    values = [3, 255, 256, 257, 1000, 123_456, 86_400_000]
    df = spark.createDataFrame([("x", v) for v in values], "g string, v bigint")
    kept = sorted(r["value"] for r in Q.value_counts(df, ["g"], "v", 0, 86_400_000, 8).collect())
    assert kept[:3] == [3, 255, 256] and all(k <= v < k * (1 + 2**-7) or k == v for k, v in zip(kept, sorted(values)[: len(kept)]) if k < 256)


def test_serving_rows_once_and_modes_even(spark):
    m = "request_id string, arrived_at timestamp, started_at timestamp, serving_mode string, measurements struct<queue_wait_ms bigint, service_ms bigint>, service_ms int"
    from datetime import datetime

    t = datetime(2026, 1, 5, 3)
    rows = [("r1", t, t, "Fallback_Direct ", (1, 2), 9), ("r1", datetime(2026, 1, 9), t, "fallback-direct", (100, 200), 9), ("r2", t, t, None, None, 9), ("r3", t, None, "worker", (5, -1), 9)]
    out = {(r["serving_mode"], str(r["day"]), r["metric"]): (r["n"], r["p50"]) for r in serving.percentiles_per(spark.createDataFrame(rows, m)).collect()}
    assert out == {("fallback-direct", "2026-01-05", "queue_wait_ms"): (1, 1), ("fallback-direct", "2026-01-05", "service_ms"): (1, 2), ("worker", "None", "queue_wait_ms"): (1, 5)}
