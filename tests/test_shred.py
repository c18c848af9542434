import json
from datetime import datetime

import pyarrow.parquet as pq
from conftest import DATA
from pyspark.sql import functions as F

from ravelin.operators import shred as S


def walk(x, path, out):
    if isinstance(x, dict):
        if path:
            out.add(path)
        for k, v in S._fields(x).items():
            walk(v, f"{path}.{k}" if path else k, out)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            walk(v, f"{path}[{i}]", out)


def paths(spark, payloads):
    df = spark.createDataFrame([(i, datetime(2026, 1, 1), p, "s") for i, p in payloads], "record_id bigint, received_at timestamp, payload string, stream string")
    return {(r["record_id"], r["node_path"]) for r in S.objects(S.shred(df)).collect()}


def test_positions_come_back_from_levels(spark):
    x = {"a": [{"b": [{"c": 1}, None, {"c": None}]}, None, {"b": []}, {"b": None}, {}], "d": {"e": {}}, "m": [[{"z": 1}], [], [None, {"y": [2, 3]}]]}
    want = set()
    walk(x, "", want)
    assert paths(spark, [(1, json.dumps(x))]) == {(1, p) for p in want}


def test_notations_are_evened_out(spark):
    one = {"runs": {"pool.queued": 1, "pool.active": None, "measurements": '{"service_ms": "7"}'}, "fixture": [{"repository": "r"}], "config": None}
    wrapped = json.dumps(json.dumps({"observations": {"diagnostics": {"kind": "k"}, "context_receipt": '{"x": {"y": 1}}'}}))
    files = [{"runs": [None, {"pool": {}}]}, None, {"runs": []}]
    got = paths(spark, [(1, json.dumps(one)), (2, "﻿ \n" + wrapped), (3, json.dumps(files)), (4, '{"a": {'), (5, ""), (6, "null"), (7, "12"), (8, '{"a": NaN, "b": {}}'), (9, None), (None, '{"a": {}}')])
    assert got == {(1, "runs[0]"), (1, "runs[0].pool"), (1, "runs[0].measurements"), (1, "fixture"), (2, "observations[0]"), (2, "observations[0].diagnostics[0]"), (2, "observations[0].context_receipt"), (2, "observations[0].context_receipt.x"), (3, "[0]"), (3, "[0].runs[1]"), (3, "[0].runs[1].pool"), (3, "[2]")}


def test_given_records_against_plain_walk(spark):
    table = pq.read_table(f"{DATA}/receipt_records.parquet").to_pylist()
    want = set()
    for r in table:
        x = S.read_payload(r["payload"])
        if x is not None and r["record_id"] is not None:
            own = set()
            walk(x, "", own)
            want |= {(r["record_id"], p) for p in own}
    df = spark.read.parquet(f"{DATA}/receipt_records.parquet")
    assert {(r["record_id"], r["node_path"]) for r in S.objects(S.shred(df)).collect()} == want


def test_flat_tables_and_links(spark):
    p = {"runs": [{"request_id": "a", "pool": {"queued": "3"}, "measurements": {"service_ms": 5.5}}, {"request_id": None, "measurements": {"service_ms": "x"}}]}
    df = spark.createDataFrame([(7, datetime(2026, 1, 1), json.dumps(p))], "record_id bigint, received_at timestamp, payload string")
    levels = S.shred(df)
    runs = {r["node_path"]: r["request_id"] for r in S.flat_table(levels, "runs").collect()}
    assert runs == {"runs[0]": "a", "runs[1]": None}
    assert [tuple(r) for r in S.flat_table(levels, "pools").select("node_path", "parent_path", "queued", "active").collect()] == [("runs[0].pool", "runs[0]", 3, None)]
    assert {(r["node_path"], r["service_ms"]) for r in S.flat_table(levels, "measurements").collect()} == {("runs[0].measurements", 5.5), ("runs[1].measurements", None)}
    assert S.flat_table(levels, "observations").collect() == []
    assert S.objects(S.shred(df.limit(0))).select(F.count("*")).first()[0] == 0


def test_nesting_has_no_limit(spark):
    """Lists 40 deep, objects 3,000 deep, and lists too deep for the C scanner."""
    deep = {"a": {"b": 1}}
    for _ in range(40):
        deep = [deep]
    objects = '{"k":' * 3000 + "1" + "}" * 3000
    lists = '{"x": ' + "[" * 30_000 + "]" * 30_000 + ', "pool": {}}'
    got = paths(spark, [(1, json.dumps({"m": deep})), (2, objects), (3, lists)])
    assert {p for r, p in got if r == 1} == {"m" + "[0]" * 40, "m" + "[0]" * 40 + ".a"}
    assert len([1 for r, _ in got if r == 2]) == 2999 and (3, "pool") in got


def test_late_paths_catch_up(spark):
    x = {"runs": [{"a": 1}, {"pool": {"queued": 1}}, {"a": {"b": {}}}, {"pool": None, "a": [[], [{"c": {}}]]}]}
    want = set()
    walk(x, "", want)
    assert paths(spark, [(1, json.dumps(x))]) == {(1, p) for p in want}


def test_repeated_values(spark):
    x = {"observations": [{"evidence": ["e", None, "f"], "paths": [["p"], [], ["q", "r"]]}, {"evidence": []}]}
    df = spark.createDataFrame([(7, datetime(2026, 1, 1), json.dumps([x]))], "record_id bigint, received_at timestamp, payload string")
    got = {tuple(r)[1:] for n in ("evidence", "paths") for r in S.value_list(S.shred(df), n).collect()}
    o = "[0].observations[0]"
    assert got == {(f"{o}.evidence[0]", o, "e"), (f"{o}.evidence[2]", o, "f"), (f"{o}.paths[0][0]", o, "p"), (f"{o}.paths[2][0]", o, "q"), (f"{o}.paths[2][1]", o, "r")}
