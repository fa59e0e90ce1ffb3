"""Sources, versioned tables and streams on local folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import changes
from siltstone.sources import repositories
from siltstone.sources.versions import BucketedTable, VersionedTable
from siltstone.streaming import pending


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.js").write_text("1")
    rows = {r["path"]: r for r in repositories.scan(spark, str(tmp_path), "r").collect()}
    assert set(rows) == {"src/a.py", "src/b.bin"}
    assert rows["src/a.py"]["text"] == "x = 1\n" and rows["src/a.py"]["language"] == "python"
    assert rows["src/b.bin"]["is_binary"] and rows["src/b.bin"]["text"] is None


def test_scenarios(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"id": "a", "query": "q", "repo": "r", "expected_results": [{"file": "f", "relevance": 1.0}], "metadata": {"category": "c"}}))
    (tmp_path / "many.json").write_text(json.dumps([{"id": "b", "query": "q", "repo": "r", "expected_results": []}]))
    rows = {r["id"]: r for r in repositories.scenarios(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["expected"][0]["file"] == "f" and rows["a"]["category"] == "c"


def test_versions_swap(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.replace(spark.range(3))
    before = t.read()
    t.replace(spark.range(5))
    assert (before.count(), t.read().count()) == (3, 5)


def test_merges_write_only_touched_buckets(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ("k",), 16)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.merge(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    before = dict(t._content()["buckets"])
    touched = t.merge(spark.createDataFrame([(7, 2), (200, 2)], "k long, v int"))
    after = t._content()["buckets"]
    assert len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    rows = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(rows) == 101 and rows[7] == rows[200] == 2 and rows[8] == 1
    assert t.merge(spark.createDataFrame([], "k long, v int")) == [] and t.read().count() == 101


def test_events_of_version_control_are_left_out(spark):
    df = spark.createDataFrame([("a.py",), (".git/HEAD",), ("x/.git/y",), ("dist/z.js",), (None,)], "path string")
    assert {r["path"] for r in pending.relevant(df, ("dist",)).collect()} == {"a.py"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "r", f"p{i % 3}", kind, dt.datetime(2024, 1, 1, 0, i)) for i, kind in enumerate(["created", "modified", "deleted", "deleted", "modified", "modified", "modified", "created"])]
    events = spark.createDataFrame(rows, pending.EVENTS)
    events.filter("id < 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    table = BucketedTable(spark, str(tmp_path / "out"), ("repo", "path"), 8)

    def drain():
        stream = spark.readStream.schema(pending.EVENTS).parquet(str(tmp_path / "in"))
        q = pending.coalesced(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(pending.merge_into(table)).trigger(availableNow=True).start()
        q.awaitTermination()

    drain()
    events.filter("id >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain()
    got = {(r["path"], r["change_type"], r["n_events"]) for r in table.read().collect()}
    want = {(r["path"], r["change_type"], r["n_events"]) for r in changes.coalesce(events).collect()}
    assert got == want


def test_windowed_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, 5), "click", 1.0) for h in (0, 0, 1)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = pending.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select * from w").select(F.col("n")).collect()) == [1, 2]
