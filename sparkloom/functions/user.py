"""User-defined functions in each of the forms that move Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar(name: str, body: Callable[..., pd.Series], kind: str) -> Callable[..., Column]:
    """A function of columns, batch by batch."""
    body.__name__ = name
    return F.pandas_udf(body, kind)


def row_by_row(body: Callable[..., object], kind: str) -> Callable[..., Column]:
    """A function of one row at a time: the slowest form, for what the others can't say."""
    return F.udf(body, kind)


@F.pandas_udf(T.DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """The mean without the least and the greatest value; null for fewer than three. One group is in memory at a time."""
    return float(values.sort_values().iloc[1:-1].mean()) if len(values) > 2 else None


@F.arrow_udf(T.LongType())
def text_bytes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of each text."""
    return pc.binary_length(texts.cast(pa.binary())).cast(pa.int64())


@F.udtf(returnType=T.StructType().add("part", "string").add("place", "integer"))
class Parts:
    """A row for each part of a text between separators."""

    def eval(self, text: str, separator: str):
        for i, part in enumerate((text or "").split(separator)):
            yield part, i


def centred(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with value less its group's mean. It shows the form, in which a worker holds a whole group: avg() over a window is the
    better plan for this."""
    kind = rows.schema
    return rows.groupBy(*keys).applyInPandas(lambda part: part.assign(**{value: part[value] - part[value].mean()}), kind)


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, spread): the greatest less the least value of each group, given as an Arrow table. It shows the form, as above."""

    def run(part: pa.Table) -> pa.Table:
        found = pc.min_max(part.column(value)).as_py()
        return pa.table({key: part.column(key).slice(0, 1), "spread": pa.array([found["max"] - found["min"]], pa.float64())})

    return rows.select(key, value).groupBy(key).applyInArrow(run, rows.select(key).schema.add("spread", "double"))


def batch_map(rows: DataFrame, body: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Each Arrow batch through a function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(body, batches)

    return rows.mapInArrow(run, schema)


def side_by_side(left: DataFrame, right: DataFrame, key: str, body: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of the rows that two tables have of a key."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(body, schema)
