import json

from ravelin.sources import sinks, specs
from ravelin.streaming import journal as J


def test_acknowledge_keeps_touched_again(spark):
    events = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30), ("a", 4, 40), (None, 5, 50)], "path string, seq int, seen_ms int")
    snapshot = J.pending(events.where("seq <= 3"), "path", "seq", "seen_ms")
    now = J.pending(events, "path", "seq", "seen_ms")
    unparsed = spark.createDataFrame([("c",)], "path string")
    assert {r["path"] for r in J.acknowledge(now, snapshot, "path", 3).collect()} == {"a"}
    assert {r["path"] for r in J.acknowledge(now, snapshot, "path", 3, unparsed).collect()} == {"a", "c"}
    assert {r["path"] for r in J.acknowledge(now, snapshot, "path", 1).collect()} == {"a", "b", "c"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 10), ("b", 2, 20), ("a", 3, 30)]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(dict(zip(("path", "seq", "seen_ms"), r))))
    stream = spark.readStream.schema("path string, seq bigint, seen_ms bigint").json(str(tmp_path / "in"))
    query = J.pending_stream(stream).writeStream.outputMode("complete").format("memory").queryName("pending").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("pending").collect()} == {("a", 1, 3, 10, 30), ("b", 2, 2, 20, 20)}
    seen = []
    sync = J.start_sync(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "check"), interval=None)
    sync.awaitTermination()
    assert seen == [(0, 2)]


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    sinks.publish({"nodes": spark.range(3)}, root, "g1")
    sinks.publish({"nodes": spark.range(5)}, root, "g2")
    assert sinks.read_current(spark, root, "nodes").count() == 5
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "generation string")
    assert [r[0] for r in sinks.reclaimable(names("g0", "g1", "g2"), names("g2"), names("g1")).collect()] == ["g0"]


def test_rendering_and_reading(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.rs").write_text("fn a() {}\n")
    (tmp_path / "x" / "b.txt").write_text("hello\nworld")
    assert specs.read_source_tree(spark, str(tmp_path)).select("n_bytes").first()[0] == 10
    assert specs.read_texts(spark, str(tmp_path), "*.txt").first()["text"] == "hello\nworld"
    d = spark.createDataFrame([(1, "r", "info", 3, "a|b")], "doc_id int, rule string, severity string, line_no int, detail string")
    assert json.loads(sinks.sarif_results(d).first()["result"])["level"] == "note"
    assert sinks.markdown_rows(d, ["rule", "detail"]).first()["line"] == "| r | a\\|b |"
