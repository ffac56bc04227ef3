"""Samples of exact size that come out the same wherever and however often they are drawn: by hashed priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import unused

SCALE = float(1 << 52)


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and below 1 from the key's text and the seed: the first 52 bits of their MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / SCALE


def stratified(rows: DataFrame, strata: list[str], key: str, size: int, seed: int = 1) -> DataFrame:
    """So many rows of each stratum, or all of a smaller one: those of the least priorities. The key tells rows apart; equal rows of
    it have equal priorities. The planner keeps so many rows of a stratum in each task before the exchange, so none is held whole."""
    place, number = unused(["place", "number"], rows.columns)
    order = Window.partitionBy(*strata).orderBy(number, key)
    return rows.withColumn(number, uniform(F.col(key), seed)).withColumn(place, F.row_number().over(order)).filter(F.col(place) <= size).drop(place, number)


def weighted(rows: DataFrame, key: str, weight: str, size: int, seed: int = 1, strata: list[str] | None = None) -> DataFrame:
    """So many rows without replacement, a row's chance at each draw being in proportion to its weight: those of the least
    -ln(u) / weight (exponential clocks). Rows of null weight, or none above zero, are never drawn."""
    (clock,) = unused(["clock"], rows.columns)
    timed = rows.filter(F.col(weight) > 0).withColumn(clock, -F.log(uniform(F.col(key), seed)) / F.col(weight))
    if not strata:
        return timed.orderBy(clock, key).limit(size).drop(clock)
    (place,) = unused(["place"], timed.columns)
    return timed.withColumn(place, F.row_number().over(Window.partitionBy(*strata).orderBy(clock, key))).filter(F.col(place) <= size).drop(place, clock)
