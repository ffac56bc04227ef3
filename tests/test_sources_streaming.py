"""Round trips of the file formats, and streams against batch."""

import pytest

from sparkloom.sources import files, generated, jdbc
from sparkloom.streaming import sinks, windows


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    files.write(rows, kind, f"{tmp_path}/x")
    assert sorted(files.read(spark, kind, f"{tmp_path}/x", "k int, s string").collect()) == sorted(rows.collect())


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        files.read(spark, "avro2", "x")


def test_tumbling_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counted = sinks.in_memory(windows.tumbling(stream, "ts", "1 hour", ["event_type"]), "counted", "complete")
    assert sorted(counted.collect()) == sorted(windows.tumbling(events, "ts", "1 hour", ["event_type"]).collect())


def test_jdbc(spark):
    """The embedded database that comes with Spark; only in local runs."""
    url, driver = "jdbc:derby:memory:loom;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).selectExpr("id AS k", "id * 2 AS v")
    jdbc.write(rows, url, "pairs", **driver)
    back = jdbc.read(spark, url, "pairs", "k", (0, 50), 4, **driver)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == [(i, 2 * i) for i in range(100)]
    assert back.filter("k < 10").count() == 10


def test_python_source(spark):
    spark.dataSource.register(generated.Numbers)
    rows = spark.read.format("numbers").option("rows", 70_001).option("parts", 3).load()
    assert rows.count() == 70_001 and rows.agg({"n": "sum"}).first()[0] == 70_000 * 70_001 // 2


def test_text_and_binary(spark, tmp_path):
    files.write(spark.createDataFrame([("a",), ("é",)], "value string").coalesce(1), "text", f"{tmp_path}/t")
    assert [r[0] for r in files.read(spark, "text", f"{tmp_path}/t").collect()] == ["a", "é"]
    assert files.read(spark, "binaryFile", f"{tmp_path}/t/*.txt").first()["content"] == "a\né\n".encode()
    with pytest.raises(ValueError):
        files.write(spark.range(1), "binaryFile", f"{tmp_path}/b")


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows behind the watermark don't count; windows that it has not passed stay open in append mode."""
    for k, hours in enumerate([[0, 1], [30], [0, 31], [60]]):
        rows = spark.createDataFrame([(h,) for h in hours], "h int").selectExpr("TIMESTAMP_NTZ'2024-01-01 00:30:00' + make_dt_interval(0, h) AS ts", "1 AS k")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/late.parquet")
        stream = sinks.file_stream(spark, f"{tmp_path}", "late")
        counted = windows.tumbling(stream, "ts", "1 hour", ["k"])
        counted.writeStream.foreachBatch(lambda rows, n: rows.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["start"].day, r["start"].hour, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 6, 1), (2, 7, 1)]


def test_ranking_windows_are_refused(spark):
    """Streams have no ranking over all rows; Spark says so when the query is started."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    stream = sinks.file_stream(spark, "/root/testdata/sf0.001", "events")
    ranked = stream.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    with pytest.raises(AnalysisException, match="NON_TIME_WINDOW_NOT_SUPPORTED_IN_STREAMING"):
        sinks.to_table(ranked, "ranked", "append")


def test_custom_state_names_its_store(spark):
    """Without RocksDB's store the error says which setting is missing."""
    from sparkloom.streaming import state

    before = spark.conf.get(state.PROVIDER)
    spark.conf.set(state.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match=state.PROVIDER):
            state.running_totals(sinks.file_stream(spark, "/root/testdata/sf0.001", "events"), "user_id", "value")
        with state.rocks(spark):
            assert spark.conf.get(state.PROVIDER) == state.ROCKS
    finally:
        spark.conf.set(state.PROVIDER, before)
