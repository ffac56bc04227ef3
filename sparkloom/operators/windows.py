"""Window forms without a syntax of their own in Spark SQL. Inner columns get names that the rows don't have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from ..names import unused


def qualify(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition on window functions holds."""
    (holds,) = unused(["holds"], rows.columns)
    return rows.withColumn(holds, condition).filter(F.col(holds)).drop(holds)


def distinct_on(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the planner keeps one row per key and task before the exchange."""
    return qualify(rows, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def groups_frame(rows: DataFrame, keys: list[str], order: str, before: int, after: int, value: Column, into: str) -> DataFrame:
    """An aggregate over a GROUPS frame: so many peer groups before and after the row's own."""
    (rank,) = unused(["rank"], rows.columns)
    ranked = rows.withColumn(rank, F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.withColumn(into, value.over(Window.partitionBy(*keys).orderBy(rank).rangeBetween(-before, after))).drop(rank)


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, n) of sessions that a pause of `gap` ends; grouped by the session struct, as only that merges them."""
    return rows.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


AGGREGATES = ("sum", "avg", "count", "min", "max")


def excluding(rows: DataFrame, keys: list[str], order: str, before: int, after: int, made: dict[str, tuple[str, str]], what: str = "current row",
              ties: Sequence[str] = ()) -> DataFrame:
    """Aggregates (name -> (sum, avg, count, min or max; column)) over a ROWS frame with an EXCLUDE clause: current row, group (the row
    and its peers) or ties (its peers only).

    `ties` are columns by which peers are put in order within the frame, all ascending; they stay peers. Without them, or where they are
    equal, too, the order of peers, and with it what a frame holds, depends on how Spark deals the rows.

    Without the current row, a frame is the two on its sides. Without a group or ties, counts and sums are the frame's less those of
    the peers within it, which are a frame of the same bounds over the peers alone; of doubles, so that finite values only are taken
    from each other, with the precision of the frame's largest. Only min and max over these hold the frame, once for all of
    them, as an array whose length the bounds limit.
    """
    if what not in ("current row", "group", "ties") or any(how not in AGGREGATES for how, _ in made.values()):
        raise ValueError(f"EXCLUDE {what} with {made}")
    number, rank, frame = unused(["number", "rank", "frame"], [*rows.columns, *made])
    by = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)))
    place = Window.partitionBy(*keys).orderBy(number)
    if what == "current row":
        columns = {into: beside(how, c, place, before, after) for into, (how, c) in made.items()}
        return numbered.select(*rows.columns, *[c.alias(into) for into, c in columns.items()])
    whole = place.rowsBetween(-before, after)
    peers = Window.partitionBy(*keys, order).orderBy(number).rowsBetween(-before, after)
    own = F.lit(before >= 0 and after >= 0 and what == "ties")
    columns, held = {}, {c for how, c in made.values() if how in ("min", "max")}
    if held:
        numbered = numbered.withColumn(rank, F.rank().over(by))
        kept = F.struct(F.col(rank).alias("r"), F.col(number).alias("n"), *[F.col(c).alias(f"v_{c}") for c in sorted(held)])
        numbered = numbered.withColumn(frame, F.collect_list(kept).over(whole))
        others = lambda x: (x["r"] != F.col(rank)) | (own & (x["n"] == F.col(number)))
    for into, (how, c) in made.items():
        if how in ("min", "max"):
            values = F.transform(F.filter(frame, lambda x: others(x) & x[f"v_{c}"].isNotNull()), lambda x: x[f"v_{c}"])
            columns[into] = (F.array_min if how == "min" else F.array_max)(values)
        else:
            columns[into] = differing(how, F.col(c), rows.schema[c].dataType, whole, peers, own)
    return numbered.select(*rows.columns, *[c.alias(into) for into, c in columns.items()])


def beside(how: str, c: str, place: WindowSpec, before: int, after: int) -> Column:
    """An aggregate over so many rows before and after the row, without it."""
    sides = [place.rowsBetween(a, b) for a, b in ((-before, -1), (1, after)) if a <= b]
    count = sum((F.count(c).over(w) for w in sides), F.lit(0).cast("long"))
    if how == "count":
        return count
    parts = [getattr(F, "sum" if how == "avg" else how)(c).over(w) for w in sides] or [F.lit(None)]
    if len(parts) == 1:
        return F.try_divide(parts[0], count) if how == "avg" else parts[0]
    if how in ("min", "max"):
        return (F.least if how == "min" else F.greatest)(*parts)
    total = F.coalesce(parts[0] + parts[1], *parts)
    return F.try_divide(total, count) if how == "avg" else total


def differing(how: str, value: Column, kind: DataType, whole: WindowSpec, peers: WindowSpec, own: Column) -> Column:
    """A count, sum or average over the frame less its peers, and with the row's own value if that is kept."""
    count = F.count(value).over(whole) - F.count(value).over(peers) + F.when(own & value.isNotNull(), 1).otherwise(0)
    if how == "count":
        return count
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = lambda v: zero(F.sum(v).over(whole)) - zero(F.sum(v).over(peers)) + zero(F.when(own, v))
    if not isinstance(kind, (DoubleType, FloatType)):
        total = sums(value)
    else:
        several = lambda test: sums(F.when(test, 1)) > 0
        high, low = (several(value == float(x)) for x in ("inf", "-inf"))
        finite = sums(F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value))
        total = F.when(several(F.isnan(value)) | (high & low), float("nan")).when(high, float("inf")).when(low, float("-inf")).otherwise(finite)
    total = F.when(count > 0, total)
    return F.try_divide(total, count) if how == "avg" else total
