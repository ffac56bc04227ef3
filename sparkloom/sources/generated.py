"""A data source written in Python: numbers in equal parts, made on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 65_536  # rows of an Arrow batch


class Span(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class Numbers(DataSource):
    """Options: rows, parts. Registered with spark.dataSource.register(Numbers), read with format("numbers")."""

    @classmethod
    def name(cls) -> str:
        return "numbers"

    def schema(self) -> str:
        return "n long"

    def reader(self, schema) -> DataSourceReader:
        return NumbersReader(int(self.options.get("rows", 1000)), int(self.options.get("parts", 8)))


class NumbersReader(DataSourceReader):
    def __init__(self, rows: int, parts: int) -> None:
        self.rows, self.parts = rows, max(1, parts)

    def partitions(self) -> list[Span]:
        return [Span(self.rows * i // self.parts, self.rows * (i + 1) // self.parts) for i in range(self.parts)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        for low in range(partition.low, partition.high, STEP):
            yield pa.RecordBatch.from_arrays([pa.array(range(low, min(low + STEP, partition.high)), pa.int64())], ["n"])
