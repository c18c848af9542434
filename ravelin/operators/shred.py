"""Columnar shredding of nested records with repetition and definition levels.

``shred`` turns each payload into one stream per leaf path: the entries'
repetition levels (at which repeated ancestor a new item began; 0: a new
record), definition levels (how many steps of the path are there) and values.
Every object also has a leaf of its own, its *marker* ``path{}``, so that
objects without any value keep their place.  The streams hold the whole
structure: ``assemble`` gets all positions back from the levels alone, and
the flat tables with their parent links follow from the positions.

A path step counts in the definition level as follows: an object or a value
that isn't null counts 1, a list 1, and an item of a list (null or not) 1.

A payload is walked once.  A path that is missing from some of its parents is
only noticed later; its stream then catches up from its parent's.  Nothing
limits how deep lists and objects are nested.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.sources.tables import earliest

#: Fields that always hold a list, and fields that always hold one object, in either receipt format (fixed values).
LIST_FIELDS = frozenset({"observations", "runs", "diagnostics"})
OBJECT_FIELDS = frozenset({"fixture", "config", "pool", "worktree", "measurements", "context_receipt"})
STREAM_SCHEMA = "record_id bigint, leaf string, max_def int, reps array<int>, defs array<int>, vals array<string>"
ENTRY_SCHEMA = "record_id bigint, leaf string, node_path string, value string"
#: Python frames that a payload may need; frames of Python functions lie on the heap.
FRAMES = 1_000_000
_OTHER, _VALUE, _OBJECT, _LIST = range(4)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


class _Deep(json.JSONDecoder):
    """For what is nested too deep for the C scanner: the same rules in Python functions."""

    def __init__(self) -> None:
        super().__init__(parse_constant=_no_constant)
        self.parse_object, self.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
        self.scan_once = json.scanner.py_make_scanner(self)


def _parse(text: str):
    text = text.strip().lstrip("﻿").strip()
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
        return _Deep().decode(text)


def _unwrapped(x):
    """JSON that was written as text, once or several times; other text stays as it is."""
    while isinstance(x, str):
        try:
            y = _parse(x)
        except ValueError:
            return x
        if not isinstance(y, dict | list | str):
            return x
        x = y
    return x


def _fields(x: dict) -> dict:
    """The fields of an object in one notation: dotted names nested, text opened, lone objects listed (one level)."""
    if not any(k in LIST_FIELDS or k in OBJECT_FIELDS or "." in k for k in x):
        return x
    out: dict = {}
    dotted: list[tuple[str, str, object]] = []
    for k, v in x.items():
        head, dot, rest = k.partition(".")
        if dot and head in OBJECT_FIELDS and rest:
            dotted.append((head, rest, v))
            continue
        if k in OBJECT_FIELDS:
            v = _unwrapped(v)
            if isinstance(v, list) and len(v) == 1:
                v = _unwrapped(v[0])
        elif k in LIST_FIELDS:
            v = _unwrapped(v)
            v = [v] if isinstance(v, dict) else [_unwrapped(i) for i in v] if isinstance(v, list) else v
        out[k] = v
    for head, rest, v in dotted:
        if not isinstance(out.get(head), dict):
            out[head] = {}
        out[head].setdefault(rest, v)
    return out


def read_payload(text: str | None):
    """The object or list of a payload; None if it can't be read in full or is neither."""
    if text is None:
        return None
    try:
        x = _parse(text)
        while isinstance(x, str):
            x = _parse(x)
    except ValueError:
        return None
    if isinstance(x, list):
        return [_unwrapped(v) for v in x]
    return x if isinstance(x, dict) else None


class _Path:
    """The stream of one path: an entry for each of its parents, and one more for each further item of a list."""

    __slots__ = ("above", "step", "top", "reps", "defs", "kinds", "vals", "fields", "item", "taken")

    def __init__(self, above: _Path | None, step: str, top: int) -> None:
        self.above, self.step, self.top = above, step, top
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.kinds: list[int] = []
        self.vals: list[str | None] = []
        self.fields: dict[str, _Path] = {}
        self.item: _Path | None = None
        #: Entries of the parent that this stream has an answer to.
        self.taken = 0

    def put(self, rep: int, d: int, kind: int, value: str | None = None) -> None:
        self.reps.append(rep)
        self.defs.append(d)
        self.kinds.append(kind)
        self.vals.append(value)

    def catch_up(self, upto: int, kind: int) -> None:
        """Entries for the parents up to number ``upto`` that hold nothing here; a parent of ``kind`` counts as there."""
        p = self.above
        for i in range(self.taken, upto):
            self.put(p.reps[i], p.defs[i] + (p.kinds[i] == kind), _OTHER)
        self.taken = upto

    def visit(self, x, rep: int, d: int, level: int, markers: bool) -> None:
        """Takes in ``x``; ``markers``: only what has objects in it."""
        here = len(self.reps)
        if isinstance(x, dict):
            self.put(rep, d, _OBJECT)
            for k, v in _fields(x).items():
                if markers and not isinstance(v, dict | list):
                    continue
                child = self.fields.get(k)
                if child is None:
                    child = self.fields[k] = _Path(self, k, self.top + 1)
                child.catch_up(here, _OBJECT)
                child.taken += 1
                child.visit(v, rep, d + 1, level, markers)
        elif isinstance(x, list):
            self.put(rep, d, _LIST)
            if not x or (markers and not any(isinstance(v, dict | list) for v in x)):
                return
            if self.item is None:
                self.item = _Path(self, "[]", self.top + 2)
            self.item.catch_up(here, _LIST)
            self.item.taken += 1
            for i, v in enumerate(x):
                self.item.visit(v, level + 1 if i else rep, d + 2, level + 1, markers)
        elif x is None:
            self.put(rep, d, _OTHER)
        else:
            self.put(rep, d, _VALUE, x if isinstance(x, str) else json.dumps(x))

    def name(self) -> str:
        steps, p = [], self
        while p.above is not None:
            steps.append("[]" if p.step == "[]" and p is p.above.item else f".{p.step}")
            p = p.above
        return "".join(reversed(steps)).removeprefix(".")

    def streams(self, markers: bool) -> Iterator[tuple]:
        """(leaf, greatest definition level, repetition levels, definition levels, values) of this path and all below."""
        todo = [self]
        while todo:
            p = todo.pop()
            for kind, children in ((_OBJECT, p.fields.values()), (_LIST, [p.item] if p.item else [])):
                for child in children:
                    child.catch_up(len(p.reps), kind)
                    todo.append(child)
            is_object = _OBJECT in p.kinds
            if is_object:
                yield p.name() + "{}", p.top + 1, p.reps, [d + (k == _OBJECT) for d, k in zip(p.defs, p.kinds)], [None] * len(p.reps)
            if not markers and (_VALUE in p.kinds or not (is_object or p.item)):
                yield p.name(), p.top + 1, p.reps, [d + (k == _VALUE) for d, k in zip(p.defs, p.kinds)], p.vals


def shred_record(x, markers: bool = False) -> list[tuple]:
    """The streams of one read payload; ``markers``: only those of objects."""
    root = _Path(None, "", 0)
    root.visit(x, 0, 0, 0, markers)
    return list(root.streams(markers))


def positions(leaf: str, max_def: int, reps: list[int], defs: list[int]) -> Iterator[tuple[int, str]]:
    """(number of the entry, path with positions) of the entries of a stream that are there.

    The position at a repeated level is the number of entries with that
    repetition level since the last entry with a smaller one.
    """
    parts = leaf.split("[]")
    at = [0] * (len(parts) - 1)
    for i, (r, d) in enumerate(zip(reps, defs)):
        if r:
            at[r - 1] += 1
        if r < len(at):
            at[r:] = [0] * (len(at) - r)
        if d == max_def:
            yield i, "".join(f"{p}[{n}]" for p, n in zip(parts, at)) + parts[-1]


def shred(records: DataFrame, markers: bool = False) -> DataFrame:
    """The level streams of all payloads (STREAM_SCHEMA), one row per record and leaf path; ``markers``: only the objects'.

    A record delivered again counts once, from its earliest arrival.  A record
    without id, or whose payload can't be read in full, has no streams.
    """

    def batches_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STREAM_SCHEMA.split(", ")]
        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for record_id, payload in zip(batch["record_id"], batch["payload"]):
                x = read_payload(payload)
                if x is None:
                    continue
                own = shred_record(x, markers)
                rows += [(record_id, *s) for s in own]
                held += sum(len(s[2]) for s in own)
                if held > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names).astype({"record_id": "int64"})

    once = earliest(records.select("record_id", "received_at", "payload"), "record_id", ["record_id", "payload"], "received_at")
    return once.mapInPandas(batches_of, STREAM_SCHEMA)


def assemble(streams: DataFrame) -> DataFrame:
    """(record_id, leaf, node_path, value): every entry that is there, with its positions filled in from the levels."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for record_id, leaf, max_def, reps, defs, vals in batch.itertuples(index=False, name=None):
                rows += [(record_id, leaf, path, vals[i]) for i, path in positions(leaf, max_def, reps.tolist(), defs.tolist())]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"record_id": "int64"})

    return streams.mapInPandas(fill, ENTRY_SCHEMA)


def objects(streams: DataFrame) -> DataFrame:
    """(record_id, object_path, node_path, parent_path) of every object below the root, from the marker streams."""
    there = assemble(streams.where(F.col("leaf").endswith("{}") & (F.col("leaf") != "{}")))
    bare = lambda c: F.substring(c, F.lit(1), F.length(c) - 2)
    return there.select("record_id", bare(F.col("leaf")).alias("object_path"), bare(F.col("node_path")).alias("node_path")).withColumn("parent_path", parent_path("node_path"))


def parent_path(c: str) -> object:
    """The path of the object that holds the object at path ``c``; empty for the root."""
    return F.regexp_replace(F.regexp_replace(c, r"(\.|^)[^.\[\]]+(\[\d+\])*$", ""), r"^(\[\d+\])$", "$1")


#: Flat tables: name -> (object path below a file, {column: type}); fixed values of the two receipt formats.
TABLES = {
    "observations": ("observations[]", {"case_id": "string", "response_bytes": "bigint", "duration_ms": "bigint", "follow_up_queries": "bigint"}),
    "diagnostics": ("observations[].diagnostics[]", {"kind": "string", "code": "string"}),
    "context_receipts": ("observations[].context_receipt", {"schema": "string", "profile": "string", "load_profile": "string", "graph_fingerprint": "string", "read_back_required": "string", "max_serialized_bytes": "bigint", "retrieval_total": "bigint", "retrieval_returned": "bigint", "retrieval_hard_cap_omitted": "bigint", "serialized_bytes": "bigint"}),
    "runs": ("runs[]", {"request_id": "string", "serving_mode": "string", "profile": "string", "outcome": "string", "diagnostic": "string", "generation": "string"}),
    "pools": ("runs[].pool", {"queued": "bigint", "active": "bigint", "outstanding": "bigint", "accepted": "bigint"}),
    "measurements": ("runs[].measurements", {"queue_wait_ms": "double", "service_ms": "double", "rss_bytes": "bigint"}),
    "worktrees": ("runs[].worktree", {"id": "string", "root_fingerprint": "string"}),
    "fixtures": ("fixture", {"repository": "string", "revision": "string"}),
    "configs": ("config", {"workers": "bigint", "queue_capacity": "bigint", "deadline_ms": "bigint"}),
}
#: Repeated values, each a child table of (record_id, node_path, parent_path, value).
VALUE_LISTS = {
    "evidence": "observations[].evidence[]",
    "paths": "observations[].paths[][]",
    "ranked_symbols": "observations[].ranked_symbols[]",
    "omission_classes": "observations[].context_receipt.omission_classes[]",
}


def _stem(path: str) -> str:
    return r"^(\[\]\.)?" + path.replace("[", r"\[").replace("]", r"\]").replace(".", r"\.")


def flat_table(streams: DataFrame, name: str) -> DataFrame:
    """One flat table: record_id, node_path, parent_path and its columns; numbers written as text are read as numbers."""
    path, columns = TABLES[name]
    entries = assemble(streams.where(F.col("leaf").rlike(_stem(path) + r"(\{\}|\.(" + "|".join(columns) + "))$")))
    marker = F.col("leaf").endswith("{}")
    own = F.when(marker, F.regexp_replace("node_path", r"\{\}$", "")).otherwise(F.regexp_replace("node_path", r"\.[^.\[\]]+$", ""))
    field = F.when(marker, F.lit("{}")).otherwise(F.regexp_extract("leaf", r"([^.\[\]]+)$", 1))
    cells = entries.select("record_id", own.alias("node_path"), field.alias("_f"), "value")
    cast = lambda c, t: F.max(F.when(F.col("_f") == c, F.col("value"))).alias(c) if t == "string" else F.expr(f"try_cast(max(CASE WHEN _f = '{c}' THEN trim(value) END) AS {'double' if t == 'double' else 'decimal(38,0)'})").cast(t).alias(c)
    rows = cells.groupBy("record_id", "node_path").agg(F.max((F.col("_f") == "{}").cast("int")).alias("_there"), *[cast(c, t) for c, t in columns.items()])
    return rows.where(F.col("_there") == 1).select("record_id", "node_path", parent_path("node_path").alias("parent_path"), *columns)


def value_list(streams: DataFrame, name: str) -> DataFrame:
    """One table of repeated values: record_id, node_path (with the value's position), parent_path (the object that holds the list), value; nulls keep their position and give no row."""
    entries = assemble(streams.where(F.col("leaf").rlike(_stem(VALUE_LISTS[name]) + "$")))
    return entries.select("record_id", "node_path", parent_path("node_path").alias("parent_path"), "value")
