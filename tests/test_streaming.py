import json

from kgloom.streaming import ingest


def test_incremental_ingest_skips_what_was_seen(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    rec = lambda p: json.dumps({"passage": p, "extracted_entities": ["a"], "extracted_triples": [["a", "r", p]]})
    for n, ps in enumerate((["x", "y"], ["y", "z"])):
        (src / f"{n}.json").write_text("\n".join(map(rec, ps)))
        ingest.ingest(ingest.read_extractions(spark, str(src)), str(out), str(ck)).awaitTermination(60)
    assert sorted(r["tail"] for r in spark.read.parquet(str(out)).collect()) == ["x", "y", "z"]


def test_stream_agrees_with_batch(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:50:00", "a", 2.0), (2, "2024-01-01 02:00:00", "b", 3.0)], "user_id long, t string, event_type string, value double").selectExpr("user_id", "cast(t as timestamp) ts", "event_type", "value")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = ingest.tumbling(s, "1 hour", late="10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, ingest.tumbling(e, "1 hour").collect()))


def test_retried_batch_is_written_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "0.json").write_text(json.dumps({"passage": "x", "extracted_entities": ["a"], "extracted_triples": [["a", "r", "x"]]}))
    for ck in ("ck1", "ck2"):  # a lost checkpoint: the same batch number comes again
        ingest.ingest(ingest.read_extractions(spark, str(src)), str(out), str(tmp_path / ck)).awaitTermination(60)
    assert [r["tail"] for r in spark.read.parquet(str(out)).collect()] == ["x"]


def test_late_events_are_left_out_of_sliding_windows(spark, tmp_path):
    from pyspark.sql import functions as F

    row = "user_id long, t string, event_type string, value double"
    on_time = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (1, "2024-01-01 05:00:00", "b", 3.0)]
    late = [(3, "2024-01-01 00:20:00", "a", 9.0), (4, "2024-01-01 06:00:00", "a", 4.0)]
    frame = lambda rows: spark.createDataFrame(rows, row).selectExpr("user_id", "cast(t as timestamp) ts", "event_type", "value").coalesce(1)
    e, shape = tmp_path / "e", frame(on_time).schema
    for n, rows in enumerate((on_time, late)):
        frame(rows).write.mode("append").parquet(str(e))
        s = spark.readStream.schema(shape).parquet(str(e))
        q = ingest.sliding(s, "1 hour", "30 minutes", late="10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = {(r.start, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    want = {(r.start, r.n) for r in ingest.sliding(frame(on_time + late[1:]), "1 hour", "30 minutes").filter(F.col("start") < F.lit("2024-01-01 05:20:00").cast("timestamp") - F.expr("interval 1 hour")).collect()}
    assert want and want <= got and all(r.total < 9 for r in spark.read.parquet(str(tmp_path / "o")).collect())
