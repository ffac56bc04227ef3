"""Streaming queries over the events table, run to the end of what is there, against batch oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, table
from ..streaming import sinks, state, windows
from .registered import query


def plain_time(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windows.tumbling(sinks.file_stream(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])
    return plain_time(sinks.to_table(counted, "tumbling", "complete"), "start")


@query("stream_sliding", """SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windows.sliding(sinks.file_stream(spark, sf_dir, "events"), "ts", "2 hours", "1 hour", ["event_type"])
    return plain_time(sinks.to_table(counted, "sliding", "complete"), "start")


@query("stream_sessions", """SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windows.sessions(sinks.file_stream(spark, sf_dir, "events"), "ts", "2 hours", ["user_id"])
    return plain_time(sinks.to_table(counted, "sessions", "complete"), "start")


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State holds the pairs seen within the watermark's delay, not all there ever were; files may come in any order within it."""
    rows = windows.deduplicated(sinks.file_stream(spark, sf_dir, "events"), "ts", ["user_id", "event_type"], "60 days")
    return sinks.to_table(rows.select("user_id", "event_type"), "distinct", "append")


LATE = 100  # of the earliest events come last


def late_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All events but the earliest ones, then those, behind the watermark that the others have set."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    first = rows.orderBy("ts", "event_id").limit(LATE)
    return [rows.join(first.select("event_id"), "event_id", "left_anti").select(rows.columns), first]


def closing(spark: SparkSession, sf_dir: str, days: list[int]) -> list[DataFrame]:
    """One event each, so many days after the last one: they close the windows before them."""
    rows = table(spark, sf_dir, "events").agg(F.max("ts").alias("ts"))
    return [rows.select(F.lit(-1).cast("long").alias("event_id"), F.expr(f"ts + INTERVAL {d} DAYS").alias("ts"), F.lit("end").alias("event_type")) for d in days]


@query("stream_late_distinct", f"SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) > {LATE}")
def late_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice, the earliest after the watermark has passed them: each other one comes out once, the late ones never."""
    rest, first = late_parts(spark, sf_dir)
    replay = sinks.Replay(spark, "late-distinct", [rest, rest, first])
    return sinks.to_table(windows.deduplicated(replay.stream, "ts", ["event_id"], "2 days").select("event_id"), "late-distinct", "append", replay)


@query("stream_late_tumbling", f"""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) > {LATE}) GROUP BY 1, 2""")
def late_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window comes out once, when the watermark has passed it; late rows don't count. A last event closes all others."""
    replay = sinks.Replay(spark, "late-tumbling", [*late_parts(spark, sf_dir), *closing(spark, sf_dir, [10, 20])])
    counted = sinks.to_table(windows.tumbling(replay.stream, "ts", "1 hour", ["event_type"]), "late-tumbling", "append", replay)
    return plain_time(counted.filter("event_type <> 'end'"), "start")


@query("sink_memory", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windows.tumbling(sinks.file_stream(spark, sf_dir, "events"), "ts", "1 day", ["event_type"])
    return plain_time(sinks.in_memory(counted, "days", "complete"), "start")


@query("stream_interval_join", """SELECT a.event_id AS seen, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS
    WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermarks allow 60 days, so that files may come in any order."""
    side = lambda kind: sinks.file_stream(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    pairs = windows.interval_join(side("view"), side("purchase"), "user_id", "ts", "12 HOURS", "60 days")
    return sinks.to_table(pairs.select(F.col("l.event_id").alias("seen"), F.col("r.event_id").alias("bought")), "interval-join", "append")


@query("stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.file_stream(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return sinks.to_table(rows.select("event_id", "c_mktsegment"), "static-join", "append")


@query("stream_totals", "SELECT user_id AS key, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state; of the rows that batches gave for a key the last has the highest count."""
    with state.rocks(spark):
        rows = sinks.to_table(state.running_totals(sinks.file_stream(spark, sf_dir, "events"), "user_id", "value"), "totals", "update")
    return rows.groupBy("key").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def ends(spark: SparkSession, sf_dir: str, days: list[int]) -> list[DataFrame]:
    """Rows like those of events, so many days after the last one: a view and a purchase of no user, behind which watermarks can go."""
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("ts"))
    kinds = F.explode(F.array(F.lit("view"), F.lit("purchase"))).alias("event_type")
    return [last.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.expr(f"ts + INTERVAL {d} DAYS").alias("ts"), kinds) for d in days]


@query("stream_outer_join", """SELECT a.event_id AS seen, b.event_id AS bought FROM events a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
    ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 3 HOURS WHERE a.event_type = 'view'""")
def outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the next three hours, or none: those come out as the watermark evicts them."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    replay = sinks.Replay(spark, "outer-join", [events, *ends(spark, sf_dir, [10, 20])])
    side = lambda kind: replay.stream.filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    pairs = windows.outer_interval_join(side("view"), side("purchase"), "user_id", "ts", "3 HOURS")
    rows = sinks.to_table(pairs.select(F.col("l.event_id").alias("seen"), F.col("r.event_id").alias("bought")), "outer-join", "append", replay)
    return rows.filter("seen >= 0")


@query("stream_sessions_by_state", """SELECT user_id AS key, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id, date_trunc('millisecond', ts) AS ts FROM events))) GROUP BY user_id, s""")
def sessions_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from list state and event-time timers, in three runs: half of the users' rows, the other half, and an end that closes all."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    replay = sinks.Replay(spark, "state-sessions", [events.filter("event_type IN ('view', 'click')"), events.filter("event_type NOT IN ('view', 'click')"), *ends(spark, sf_dir, [100, 200])])
    with state.rocks(spark):
        rows = sinks.to_table(state.sessions_by_state(replay.stream, "user_id", "ts", "event_type", 2 * 3_600_000, "60 days"), "state-sessions", "append", replay)
    time = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return rows.filter("key >= 0").select("key", time(F.col("start")).alias("start"), time(F.col("end")).alias("last"), "n")


@query("stream_state_rows", "SELECT user_id AS key, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def rows_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What map state with a time to live holds at the end, read back from the checkpoint: events of each user and type."""
    place = scratch(spark, "state-rows")
    with state.rocks(spark), state.only_with_rows(spark):
        sinks.to_table(state.first_seen(sinks.file_stream(spark, sf_dir, "events"), "user_id", "event_type", 24 * 3_600_000), "first-seen", "update", checkpoint=place)
    rows = state.state_rows(spark, place, "seen")
    return rows.select(F.col("key.key").alias("key"), F.col("user_map_key.kind").alias("kind"), F.col("user_map_value.value.n").alias("n"))


@query("stream_chained_windows", "SELECT date_trunc('day', ts) AS start, count(DISTINCT date_trunc('hour', ts)) AS windows, count(*) AS n FROM events GROUP BY 1")
def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, then days of hours. Closing events let the watermark pass all windows of both; theirs are filtered out."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    replay = sinks.Replay(spark, "chained", [events, *closing(spark, sf_dir, [10, 20, 30])])
    rows = plain_time(sinks.to_table(windows.rolled_up(replay.stream, "ts", "1 hour", "1 day"), "chained", "append", replay), "start")
    return rows.join(F.broadcast(events.agg(F.max("ts").alias("last"))), F.col("start") <= F.col("last")).drop("last")
