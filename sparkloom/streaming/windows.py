"""Streaming aggregation over event time. Timestamps without a zone are cast, as watermarks refuse them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, at: str, late: str) -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(stream: DataFrame, at: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per key and window."""
    counted = timed(stream, at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def deduplicated(stream: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark's delay; rows behind the watermark are dropped, and so is state it has passed."""
    return timed(stream, at, late).dropDuplicatesWithinWatermark(keys)


def sliding(stream: DataFrame, at: str, width: str, slide: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per key and window, windows overlapping."""
    counted = timed(stream, at, late).groupBy(F.window(at, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per key and session; grouped by the session struct, as only that merges sessions."""
    counted = timed(stream, at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of left and right rows of a key, right not before left and no later than `within` after; both columns sets are kept as l and r."""
    a, b = (timed(side, at, late).select(F.col(key).alias(f"{n}_key"), F.col(at).alias(f"{n}_at"), F.struct(*side.columns).alias(n)) for n, side in (("l", left), ("r", right)))
    near = F.col("r_at").between(F.col("l_at"), F.col("l_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("l_key") == F.col("r_key")) & near).select("l", "r")


def outer_interval_join(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str = "1 hour") -> DataFrame:
    """interval_join with left's other rows, r being null. Such a row comes out once the watermarks of both sides have passed all
    that it could meet, so the last ones need later rows on both sides."""
    a, b = (timed(side, at, late).select(F.col(key).alias(f"{n}_key"), F.col(at).alias(f"{n}_at"), F.struct(*side.columns).alias(n)) for n, side in (("l", left), ("r", right)))
    near = F.col("r_at").between(F.col("l_at"), F.col("l_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("l_key") == F.col("r_key")) & near, "left_outer").select("l", "r")


def rolled_up(stream: DataFrame, at: str, fine: str, coarse: str, late: str = "1 hour") -> DataFrame:
    """Two chained window aggregations: counts per fine window, and their number and sum per coarse one."""
    inner = timed(stream, at, late).groupBy(F.window(at, fine)).agg(F.count("*").alias("n"))
    outer = inner.groupBy(F.window(F.window_time("window"), coarse).alias("w")).agg(F.count("*").alias("windows"), F.sum("n").alias("n"))
    return outer.select(F.col("w.start").alias("start"), "windows", "n")
