from tidemill.streaming.changes import SnapshotTable, upserts


def test_upserts(spark, tmp_path):
    schema = "key string, value string, seq long"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 3)], schema).write.parquet(source)
    start = spark.createDataFrame([("a", "0"), ("c", "9")], "key string, value string")
    table = SnapshotTable(start, str(tmp_path / "out"))
    q = upserts(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, table.current.collect())) == [("a", "2"), ("b", "3"), ("c", "9")]
