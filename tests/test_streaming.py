from __future__ import annotations

import json

from lexispark import streaming
from lexispark.sources import manifest


def test_tumbling_and_sessions(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.sql("select cast(id as long) event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,cast(id as int)) ts, id % 2 user_id, 'a' event_type, 1.0D value from range(48)")
    rows.write.parquet(src)
    events = streaming.read_events(spark, src)
    streaming.run_available(streaming.dedup(events), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 48
    query = streaming.tumbling_totals(events).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("totals").collect()) == [24, 24]
    query = streaming.sessions(events, "30 minutes").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("sess").count() == 48


def test_glue(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("r", 0.0, 1.0, "a"), ("r", 1.5, 2.0, "b"), ("r", 9.0, 10.0, "c")], "rec string, start double, end double, text string").coalesce(1).write.parquet(src)
    df = streaming.glue(spark.readStream.schema("rec string, start double, end double, text string").parquet(src))
    streaming.run_available(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.start, r.end, r.text, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0.0, 2.0, "a b", 2)]


def test_manifest_stream(spark, tmp_path):
    src = tmp_path / "m"
    src.mkdir()
    (src / "a.jsonl").write_text(json.dumps({"id": "1", "conversations": []}) + "\n")
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    streaming.run_available(manifest.stream(spark, str(src)), out, cp)
    (src / "b.jsonl").write_text(json.dumps({"id": "2"}) + "\n")
    streaming.run_available(manifest.stream(spark, str(src)), out, cp)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2"]
