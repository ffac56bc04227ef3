"""Running values over a global order, or over keys that hold many rows: distributed prefix sums.

A window without a partition reads all rows in one task, one by a hot key most of them. Here rows are dealt by ranges of (keys,
order), so that a range is a task's share whatever the keys are; each range computes its own running values; and what earlier ranges
of the same key amount to is carried over by a side table. Only keys at the ends of ranges are cut, so that table has at
most two rows for each range, and is broadcast.

The ranges are written to the shared folder: they come from a sample of the rows, and have to be the same ones in both passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import unused
from ..stored import save

RANGE_ROWS = 250_000

#: What `running` makes. Those of the second line look at a value, the others at places only.
PLACES = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
VALUES = ("count", "sum", "avg", "min", "max")


def directed(order: list[str]) -> list[Column]:
    """Sort columns of names, of which "-name" is descending; nulls come first, in descending order last."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], part: str, parts: int | None = None) -> DataFrame:
    """rows, saved, with the number of the range of (keys, order) that they are in. Rows equal in both stay together, so what
    isn't to be kept together needs a further column to be ordered by. Without a number of parts, there are as many as rows need at
    RANGE_ROWS each, and no fewer than cores, so that a task's memory doesn't grow with the table; rows are counted for it."""
    by = [*[F.col(k).asc() for k in keys], *directed(order)]
    parts = parts or max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    return save(rows.repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id()), "ranges")


def by_part(ranged: DataFrame, part: str) -> DataFrame:
    """ranged with each range in one task, and as many tasks as ranges (of a file each): otherwise the number of tasks would not grow
    with the table."""
    return ranged.repartition(max(len(ranged.inputFiles()), 1), part)


def key_of(keys: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def cut_keys(ranged: DataFrame, keys: list[str], part: str) -> DataFrame:
    """One column, k: the keys that are in several ranges, found at the ranges' ends."""
    ends = ranged.groupBy(part).agg(F.min(key_of(keys)).alias("low"), F.max(key_of(keys)).alias("high"))
    each = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("k"))
    return each.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")


def carried(ranged: DataFrame, keys: list[str], part: str, partial: dict[str, Column], over: dict[str, tuple[str, Callable[[str], Column]]], later: bool = False) -> DataFrame:
    """(k, p, ...) of cut keys in each range p: of each name in over, an aggregate of the named column of partial (one for each key
    and range) over the ranges before p; after it, from the nearest one, if later. Names that begin with all: over all ranges."""
    own, other = unused(["own", "other"], [*ranged.columns, *partial])
    met = ranged.withColumn(own, key_of(keys))
    if keys:
        cut = cut_keys(ranged, keys, part).withColumnRenamed("k", other)  # a row for each range at most
        met = met.join(F.broadcast(cut), F.col(own) == F.col(other))
    sums = met.groupBy(F.col(own).alias("k"), F.col(part).alias("p")).agg(*[c.alias(f"__{name}") for name, c in partial.items()])
    by = Window.partitionBy("k")
    near = by.orderBy(F.desc("p") if later else F.asc("p")).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("k", "p", *[f(f"__{of}").over(by if name.startswith("all") else near).alias(name) for name, (of, f) in over.items()])


def with_carried(ranged: DataFrame, keys: list[str], part: str, side: DataFrame, names: list[str]) -> DataFrame:
    """ranged with a struct column (names[0]) of what was carried to the row's key and range; null for keys that aren't cut."""
    own = [c for c in side.columns if c not in ("k", "p")]
    held = side.select(F.col("k").alias(names[1]), F.col("p").alias(names[2]), F.struct(*own).alias(names[0]))
    same = F.col(part) == F.col(names[2])
    return ranged.join(F.broadcast(held), (key_of(keys) == F.col(names[1])) & same if keys else same, "left").drop(*names[1:])


def running(rows: DataFrame, keys: list[str], order: list[str], made: dict[str, tuple], peers: bool = False, parts: int | None = None) -> DataFrame:
    """rows with a column for each of `made`: name -> (what,), ("ntile", number) or (what of VALUES, column).

    Values run from a key's first row to the row itself, with peers to its last equal in order; without, and for row_number and
    ntile, rows equal in order come in any sequence. No keys: one order over all rows. Sums of numbers with fractions may differ in
    the last digits from those of one task. Nulls in keys are a key, and nulls in values are left out, as in a window.
    """
    part, kept, k, p, total = unused(["part", "carried", "k", "p", "total"], [*rows.columns, *made])
    unknown = [what for what, *_ in made.values() if what not in PLACES + VALUES]
    if unknown or not order:
        raise ValueError(f"running {unknown or 'values without an order'}")
    ranged = in_ranges(rows, keys, order, part, parts)
    plain = F.struct(*[F.col(c.removeprefix("-")) for c in order])
    partial, over = {"n": F.count("*")}, {"n": ("n", F.sum), "all_n": ("n", F.sum)}
    if any(what == "dense_rank" for what, *_ in made.values()):
        partial["distinct"], over["distinct"] = F.count_distinct(plain), ("distinct", F.sum)
    for into, (what, *more) in made.items():
        if what in VALUES:
            value = F.col(more[0])
            for name, f in {"count": {"c": F.count}, "avg": {"c": F.count, "s": F.sum}}.get(what, {what: getattr(F, what)}).items():
                partial[f"{name}_{into}"] = f(value)
                over[f"{name}_{into}"] = (f"{name}_{into}", F.sum if name in ("c", "s") else f)
    side = carried(ranged, keys, part, partial, over)
    met = with_carried(by_part(ranged, part), keys, part, side, [kept, k, p])
    own = Window.partitionBy(*keys, part)
    places, frame = own.orderBy(*directed(order)), Window.unboundedPreceding
    values = places.rangeBetween(frame, 0) if peers else places.rowsBetween(frame, 0)
    before = lambda name: F.coalesce(F.col(kept)[name], F.lit(0))
    met = met.withColumn(total, F.coalesce(F.col(kept)["all_n"], F.count("*").over(own)))
    number, rank = F.row_number().over(places) + before("n"), F.rank().over(places) + before("n")

    def value_of(what: str, into: str, c: str) -> Column:
        earlier = lambda name: F.col(kept)[f"{name}_{into}"]
        if what == "count":
            return F.count(c).over(values) + F.coalesce(earlier("c"), F.lit(0))
        if what in ("min", "max"):
            return (F.least if what == "min" else F.greatest)(getattr(F, what)(c).over(values), earlier(what))
        sums = lambda here, there: F.coalesce(here + there, here, there)
        if what == "sum":
            return sums(F.sum(c).over(values), earlier("sum"))
        return F.try_divide(sums(F.sum(c).over(values), earlier("s")), (F.count(c).over(values) + F.coalesce(earlier("c"), F.lit(0))))

    def place_of(what: str, number_of: int | None = None) -> Column:
        if what == "row_number":
            return number
        if what == "rank":
            return rank
        if what == "dense_rank":
            return F.dense_rank().over(places) + before("distinct")
        if what == "percent_rank":
            return F.when(F.col(total) > 1, (rank - 1) / (F.col(total) - 1)).otherwise(0.0)
        if what == "cume_dist":
            return (F.count("*").over(places.rangeBetween(frame, 0)) + before("n")) / F.col(total)
        # The first groups have one row more, where the number doesn't divide the total.
        low, more = F.floor(F.col(total) / number_of), F.col(total) % number_of
        wide = more * (low + 1)
        return F.when(number <= wide, F.floor((number - 1) / (low + 1)) + 1).otherwise(more + F.floor(F.try_divide(number - 1 - wide, low)) + 1)

    columns = {into: (value_of(what, into, *more) if what in VALUES else place_of(what, *more)) for into, (what, *more) in made.items()}
    return met.select(*rows.columns, *[c.alias(into) for into, c in columns.items()])
