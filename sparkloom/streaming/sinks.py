"""Sources and sinks of streams over tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch


def file_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; the table may be one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    files = batch.inputFiles()
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", per_trigger)
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


class Replay:
    """A stream that gets these tables, all of one schema, one after another: what to_table() makes of it has seen all files of a
    table before those of the next one come. Tables are written as they are dealt, in any number of files."""

    def __init__(self, spark: SparkSession, name: str, parts: list[DataFrame]) -> None:
        self.path, self.later = scratch(spark, f"replay-{name}"), parts[1:]
        parts[0].write.parquet(self.path)
        self.spark, self.schema = spark, parts[0].schema

    @property
    def stream(self) -> DataFrame:
        """A new one each time, so that the two sides of a join are two."""
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def feed(self) -> bool:
        """Writes the next table, if there is one."""
        if not self.later:
            return False
        self.later.pop(0).write.mode("append").parquet(self.path)
        return True


def in_memory(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The same in a table in the driver's memory: for small results only."""
    table = f"{name}_{uuid.uuid4().hex}"
    place = scratch(stream.sparkSession, f"memory-{name}")
    stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(table)


def to_table(stream: DataFrame, name: str, mode: str, replay: Replay | None = None, checkpoint: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now, and for what a replay has to come. Every batch is written by the executors to a folder of its own number,
    overwritten if the batch is repeated; in complete mode the last one counts, in the other modes all of them."""
    spark = stream.sparkSession
    root = scratch(spark, f"stream-{name}")
    last = [-1]

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        last[0] = max(last[0], number)

    more = True
    while more:
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint or f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        more = bool(replay and replay.feed())
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{root}/out/batch={last[0]}" if mode == "complete" else f"{root}/out/batch=*")
