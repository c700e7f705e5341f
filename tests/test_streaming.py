from datetime import datetime

from quillspark.streaming import jobs

RUN = "source_name string, finished_at timestamp, inserted int, error string"


def test_ingest_and_health(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 5), 3, None), ("a", datetime(2024, 1, 1, 0, 50), 2, "x"), ("a", datetime(2024, 1, 1, 1, 5), 1, None)]
    spark.createDataFrame(rows, RUN).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = jobs.ingest_directory(spark, str(tmp_path / "in"), RUN, lambda df, epoch: seen.append(df.count()), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert seen == [3]
    stream = spark.readStream.schema(RUN).parquet(str(tmp_path / "in"))
    q = jobs.run_health(stream).writeStream.format("memory").queryName("health").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.runs, r.failed, r.inserted) for r in spark.table("health").collect()) == [(1, 0, 1), (2, 1, 5)]


def test_topic_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    schema = "document_id int, tags array<string>, request_ts timestamp, seq int"
    rows = [(1, ["a", "b"], datetime(2024, 1, 1), 1), (1, ["b"], datetime(2024, 1, 2), 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = jobs.fold_topics(stream).writeStream.format("memory").queryName("fold").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r.topic_slug, r.assigned) for r in spark.table("fold").collect()) == [("a", False), ("a", True), ("b", True)]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_health_appends_closed_intervals(spark, tmp_path):
    """A late row that the watermark has passed isn't counted, and an interval is given once."""
    batches = [[("a", datetime(2024, 1, 1, 0, 5), 3, None), ("a", datetime(2024, 1, 1, 0, 50), 2, "x")], [("a", datetime(2024, 1, 1, 2, 30), 1, None)], [("a", datetime(2024, 1, 1, 0, 10), 9, None), ("a", datetime(2024, 1, 1, 5, 0), 1, None)]]
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RUN).parquet(str(tmp_path / "in"))
        q = jobs.run_health(stream).writeStream.foreachBatch(lambda df, _: out.extend((r.runs, r.failed, r.inserted) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert out == [(2, 1, 5), (1, 0, 1)]


def test_replays_and_latest(spark, tmp_path):
    schema = "canonical_url string, retrieved_at timestamp, created_at timestamp, id int, v int"
    at = [datetime(2024, 1, 1, 0, 0, s) for s in range(5)]
    spark.createDataFrame([("u", at[0], at[0], 1, 1), ("u", at[3], at[3], 2, 2), ("w", at[1], at[1], 3, 3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", jobs.without_replays(read()), "append"), ("newest", jobs.latest_by(read(), "canonical_url", "created_at", "id", "v"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.canonical_url for r in spark.table("once").collect()) == ["u", "w"]
    assert sorted((r.canonical_url, r.v) for r in spark.table("newest").collect()) == [("u", 2), ("w", 3)]
