"""Custom state per key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rocks(spark: SparkSession) -> AbstractContextManager[None]:
    """RocksDB's state store for the streams that are started within, in sessions that `session()` didn't make."""
    return setting(spark, PROVIDER, ROCKS)


def only_with_rows(spark: SparkSession) -> AbstractContextManager[None]:
    """No batches without rows, of which state that lives by processing time has one after another: a run would have no end."""
    return setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false")


class Totals(StatefulProcessor):
    """Running count and sum of a key; each batch that has the key gives one row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.held.get() if self.held.exists() else (0, 0.0)
        for part in rows:
            n, total = n + len(part), total + float(part["value"].sum())
        self.held.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Sessions of a key that a pause of `gap` ends, from rows in any order within the watermark.

    A list holds the open ones (start, end, rows), merged with what comes. When the watermark has passed one's end plus the gap, no row
    can reach it any more: a key has a single timer, for the first of its sessions, and when that rings all that are over
    come out at once. A map counts the rows of each kind over the key's whole life."""

    def __init__(self, gap: int) -> None:
        self.gap = gap  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, n long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans, kinds = [tuple(map(int, x)) for x in self.open.get()], Counter()
        for part in rows:
            spans += [(int(t), int(t), 1) for t in part["at"]]
            kinds.update(part["kind"])
        merged: list[tuple[int, int, int]] = []
        for start, end, n in sorted(spans):
            if merged and start - merged[-1][1] <= self.gap:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]), merged[-1][2] + n)
            else:
                merged.append((start, end, n))
        for kind, n in kinds.items():
            self.kinds.updateValue((kind,), ((self.kinds.getValue((kind,)) or (0,))[0] + n,))
        self.keep(merged, list(self.handle.listTimers()))
        return iter(())

    def keep(self, spans: list[tuple[int, int, int]], timers: list[int]) -> None:
        """The open sessions, with a timer for the first to end; timers: those there are."""
        first = min(end for _, end, _ in spans) + self.gap + 1 if spans else None
        for t in timers:
            if t != first:
                self.handle.deleteTimer(t)
        if spans:
            self.open.put(spans)
            if first not in timers:
                self.handle.registerTimer(first)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        spans = [tuple(map(int, x)) for x in self.open.get()]
        done = [s for s in spans if s[1] + self.gap < now]
        if not done:
            return
        self.keep([s for s in spans if s[1] + self.gap >= now], [])  # the timer that rang goes by itself
        yield pd.DataFrame({"key": [key[0]] * len(done), "start": [s[0] for s in done], "end": [s[1] for s in done], "n": [s[2] for s in done]}).astype(NO_SESSIONS.dtypes.to_dict())

    def close(self) -> None:
        pass


NO_SESSIONS = pd.DataFrame({"key": [], "start": [], "end": [], "n": []}, dtype="int64")


def sessions_by_state(stream: DataFrame, key: str, at: str, kind: str, gap_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions once the watermark has passed them; start and end in milliseconds."""
    needs_rocks(stream)
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("time"), F.col(kind).alias("kind")).withWatermark("time", late)
    rows = rows.withColumn("at", F.unix_millis("time")).groupBy("key")
    return rows.transformWithStateInPandas(Sessions(gap_ms), outputStructType="key long, start long, end long, n long", outputMode="append", timeMode="eventTime")


class FirstSeen(StatefulProcessor):
    """The first row of each kind of a key, kinds being forgotten when they weren't seen for `ttl`."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "n long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for part in rows:
            counts.update(part["kind"])
        fresh = [k for k in counts if not self.seen.containsKey((k,))]
        for k, n in counts.items():
            self.seen.updateValue((k,), ((0 if k in fresh else self.seen.getValue((k,))[0]) + n,))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(fresh), dtype="int64"), "kind": pd.Series(fresh, dtype="object")})

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, kind: str, ttl_ms: int) -> DataFrame:
    """(key, kind) of each kind that is new to a key, or new again after it was away for the time that state lives (processing time)."""
    needs_rocks(stream)
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(kind).alias("kind")).groupBy("key")
    return rows.transformWithStateInPandas(FirstSeen(ttl_ms), outputStructType="key long, kind string", outputMode="update", timeMode="processingTime")


def state_rows(spark: SparkSession, checkpoint: str, variable: str, flat: bool = True) -> DataFrame:
    """The rows of a state variable as the last batch left them, read from a stream's checkpoint; lists and maps a row an element."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return reader.option("flattenCollectionTypes", str(flat).lower()).load(checkpoint)


def needs_rocks(stream: DataFrame) -> None:
    if stream.sparkSession.conf.get(PROVIDER) != ROCKS:
        raise ValueError(f"custom state needs {PROVIDER} to be RocksDB's")


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch. The session's state store has to be RocksDB's, as `session()` sets it."""
    needs_rocks(stream)
    rows = stream.selectExpr(f"CAST({key} AS BIGINT) AS key", f"CAST({value} AS DOUBLE) AS value").groupBy("key")
    return rows.transformWithStateInPandas(Totals(), outputStructType="key long, n long, total double", outputMode="update", timeMode="none")
