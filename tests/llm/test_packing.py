import random
from collections import defaultdict

from pyspark.sql import functions as F

from ravelin.llm import packing as P


def test_containers_hold_everything_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "b", None, ""]), rng.choice([1, 40, 300, 700, 2048, 2049, 5000, 0])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")
    placed = P.pack(df, windows=4, block_containers=4).collect()
    size, source = {i: n for i, _, n in rows}, {i: s for i, s, _ in rows}
    parts, fill = defaultdict(list), defaultdict(int)
    for r in placed:
        parts[r["doc_id"]].append((r["piece"], r["token_start"], r["tokens"]))
        fill[r["source"], r["container_id"]] += r["tokens"]
        assert r["source"] == source[r["doc_id"]]
    assert set(parts) == {i for i, n in size.items() if n}
    for i, ps in parts.items():
        assert sum(t for _, _, t in ps) == size[i]
        assert [s for _, s, _ in sorted(ps)] == [2048 * k for k in range(len(ps))]
        assert len(ps) == 1 or size[i] > 2048
    assert max(fill.values()) <= 2048
    for s in {"a", "b", None, ""}:
        own = [f for (t, _), f in fill.items() if t == s]
        assert len(own) <= 1.05 * sum(own) / 2048 + 2
    assert P.containers(P.pack(df)).agg(F.max("fill")).first()[0] <= 2048


def test_best_fit_keeps_few_windows_open():
    items = [(i, 0, s) for i, s in enumerate([6, 6, 4, 4, 9, 1])]
    out = list(P._online("b", iter(items), 10, 2))
    assert [[i[2] for i in held] for _, _, held in out] == [[6, 4], [6, 4], [9, 1]]
    assert P.best_fit_decreasing([6, 6, 4, 4, 9, 1], 10) == [1, 2, 1, 2, 0, 0]


def test_whole_texts_are_counted(spark):
    rows = [(1, "s", "hello world"), (2, "s", ""), (3, "s", None), (4, None, "x " * 50_000), (5, "s", " "), (6, "s", "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df).collect()}
    assert set(got) == {1, 4, 5, 6} and got[1] == 2 and got[4] >= 50_000 and got[6] > 1
    assert P.pack(P.token_counts(df.limit(0))).collect() == []
