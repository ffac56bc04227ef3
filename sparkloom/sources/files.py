"""Reading and writing the built-in file formats by one name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "xml", "text", "binaryFile")


def read(spark: SparkSession, kind: str, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A scan; give a schema where the format doesn't have one, so that no pass is spent on inferring it."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(rows: DataFrame, kind: str, path: str, by: tuple[str, ...] = (), **options: str) -> None:
    """A sink, partitioned by columns if any are given."""
    if kind not in FORMATS or kind == "binaryFile":
        raise ValueError(f"cannot write {kind}")
    writer = rows.write.format(kind).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)
