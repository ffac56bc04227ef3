"""Exact percentiles without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import unused
from ..stored import BROADCAST_ROWS, drop, save

ACCURACY = 10_000
BINS = 1000


def percentile(rows: DataFrame, keys: list[str], value: str, share: float, into: str, discrete: bool = False, bins: int = BINS) -> DataFrame:
    """(keys, into): the exact percentile of each group's values that aren't null, interpolated or, if discrete, one of them.

    1. A sketch bounds the wanted place from both sides for each group: its ranks are right to a part in ACCURACY, so the bounds
       enclose some ten-thousandths of the rows. A second pass counts what is below, and the values between the bounds, equal
       ones as one row, with the nearest value on either side. These rows go to the shared folder.
    2. A histogram of so many bins counts what is between, with each bin's least and largest value. The bin that holds the place
       makes the next bounds, until the place is known: its bin has a single value, or the place is a bin's end. Each round divides
       the span of the values, or of their logarithms where they are of different magnitudes, by the bins, so a few rounds are
       enough for any doubles and any ties.

    All passes aggregate partially, and what is brought together for a group is its bins: no task orders, holds or reads a group.
    Groups without a value have no row. Infinite values count like others; NaN is above them.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be from 0 to 1")
    low, high, n, below, v, c = unused(["low", "high", "n", "below", "v", "c"], keys)
    rows = rows.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias(v)).filter(F.col(v).isNotNull())  # -0.0 is 0.0
    margin = 3 / ACCURACY
    at = lambda p, least: (F.min(v) if p <= 0 else F.max(v) if p >= 1 else F.percentile_approx(v, p, ACCURACY)).alias(least)
    bounds = rows.groupBy(*keys).agg(F.count("*").alias(n), at(share - margin, low), at(share + margin, high))
    bounds = save(bounds, "percentile-bounds")
    side = F.when(F.col(v) < F.col(low), -1).when(F.col(v) > F.col(high), 1).otherwise(0)
    each = with_bounds(rows, bounds, keys).groupBy(*keys, side.alias("__side"), F.when(side == 0, F.col(v)).alias(v))
    counted = save(each.agg(F.count("*").alias(c), F.min(v).alias("__least"), F.max(v).alias("__most")), "percentile-band")
    # What is below or above the bounds is one row of a group each. In few rows, the place may be that of the last value below or of
    # the first above, which therefore belong to the band as well, once.
    under, over = (counted.filter(f"__side = {x}") for x in (-1, 1))
    ends = under.select(*keys, F.col("__most").alias(v), F.lit(1).cast("long").alias(c)).union(over.select(*keys, F.col("__least").alias(v), F.lit(1).cast("long").alias(c)))
    band, found = counted.filter("__side = 0").select(*keys, v, c).union(ends), []
    state = joined_by(bounds, under.select(*keys, (F.col(c) - 1).alias(below), F.col("__most").alias("__under")), keys, "left")
    state = joined_by(state, over.select(*keys, F.col("__least").alias("__over")), keys, "left")
    state = state.select(*keys, n, F.coalesce("__under", low).alias(low), F.coalesce("__over", high).alias(high), F.coalesce(below, F.lit(0)).alias(below))
    while True:
        found.append(save(narrowed(band, state, keys, share, discrete, bins, (low, high, n, below, v, c)), "percentile-step"))
        state = found[-1].filter("NOT done").drop("done")
        if not state.head(1):
            break
    drop(bounds, counted)
    done = found[0].filter("done")
    for more in found[1:]:
        done = done.union(more.filter("done"))
    place = F.lit(share) * (F.col(n) - 1)
    first, second = F.col(low), F.col(high)
    # Equal ends are taken as they are: a difference of infinite ones is no number.
    exact = first if discrete else F.when(first == second, first).otherwise(first + (second - first) * (place - F.floor(place)))
    return done.select(*keys, exact.alias(into))


def joined_by(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """rows with the columns of side, which has a row at most for each value of the keys; null keys are equal."""
    own = dict(zip(keys, unused([f"own_{k}" for k in keys], [*rows.columns, *side.columns])))
    other = side.withColumnsRenamed(own)
    same = F.lit(True)
    for k, name in own.items():
        same &= F.col(k).eqNullSafe(F.col(name))
    return rows.join(F.broadcast(other) if small else other, same, how).drop(*own.values())


def with_bounds(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Broadcast if there are few groups, so that a hot one needs no exchange; else adaptive execution splits it."""
    return joined_by(rows, bounds, keys, small=not keys or bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS)


def magnitude(v: Column) -> Column:
    """A number that never falls as v rises and is finite for all doubles: the signed logarithm, from the least positive one."""
    size = F.log(F.abs(v)) + 746
    return F.when(F.isnan(v), 1600.0).when(v == 0, 0.0).when(F.abs(v) == float("inf"), F.signum(v) * 1500).otherwise(F.signum(v) * size)


def narrowed(band: DataFrame, state: DataFrame, keys: list[str], share: float, discrete: bool, bins: int, names: tuple[str, ...]) -> DataFrame:
    """(keys, n, low, high, below, done) of the groups of state (keys, n, low, high, below): the bounds after a histogram of band (keys, v,
    c) between them; done: low and high are the values at the wanted place and, if it lies between two, the next."""
    low, high, n, below, v, c = names
    lo, hi, x = F.col(low), F.col(high), F.col(v)
    spread = magnitude(hi) - magnitude(lo)
    by_size = F.isnan(hi) | (spread > 1) | (F.abs(hi - lo) == float("inf"))
    part = F.when(by_size, F.try_divide(magnitude(x) - magnitude(lo), spread)).otherwise(F.try_divide(x - lo, hi - lo))
    number = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * bins), F.lit(bins - 1))
    kept = with_bounds(band, state, keys).filter((x >= lo) & (x <= hi))
    each = kept.groupBy(*keys, n, below, number.alias("__bin")).agg(F.sum(c).alias("__c"), F.min(v).alias("__low"), F.max(v).alias("__high"))
    together = F.sort_array(F.collect_list(F.struct("__bin", "__c", "__low", "__high")))  # of so many bins at most
    of_group = each.groupBy(*keys, n, below).agg(together.alias("__bins"))
    place = F.lit(share) * (F.col(n) - 1)
    first = F.greatest(F.ceil(F.lit(share) * F.col(n)) - 1, F.lit(0)) if discrete else F.floor(place)
    second = first if discrete else F.ceil(place)
    start = F.struct(F.col(below).alias("upto"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.col(below).alias("before"))

    def step(acc: Column, b: Column) -> Column:
        """a to b: the bin of the first place, y to z: of the second."""
        upto = acc["upto"] + b["__c"]
        holds = lambda r: (r >= acc["upto"]) & (r < upto)
        keep = lambda r, name, field: F.when(holds(r), b[field]).otherwise(acc[name]).alias(name)
        return F.struct(upto.alias("upto"), keep(first, "a", "__low"), keep(first, "b", "__high"), keep(second, "y", "__low"), keep(second, "z", "__high"), F.when(holds(first), acc["upto"]).otherwise(acc["before"]).alias("before"))

    met = of_group.withColumn("__at", F.aggregate("__bins", start, step))
    a, b, y, z = (F.col(f"__at.{name}") for name in "abyz")
    apart = a.eqNullSafe(y) == F.lit(False)  # the places are in two bins: the end of one, the begin of the other
    return met.select(
        *keys, n, F.when(apart, b).otherwise(a).alias(low), F.when(apart, y).otherwise(z).alias(high), F.col("__at.before").alias(below), (apart | (a == b)).alias("done")
    )
