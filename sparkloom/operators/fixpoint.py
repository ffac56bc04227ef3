"""Recursion over frames: semi-naive rounds, whose state is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import unused
from ..stored import drop, save

COMPACT = 8  # rounds whose new rows are kept as a table each


def fixpoint(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """The rows of start and all that step makes of them, one for each value of the keys: that of the first round that has it.

    step gets the rows that are new in a round, and its number from one, never all rows; what it returns is new where no row before
    has its keys. Each round's new rows are written to the shared folder, so a plan is as deep as one round however many there are,
    and a lost executor costs a round's tasks. Ends without new rows, or after so many rounds. Of several rows with the same keys
    in a round any one counts. Null keys are equal.
    """
    new = save(start.dropDuplicates(keys), "fixpoint")
    parts, number = [new], 0
    while (rounds is None or number < rounds) and new.head(1):
        number += 1
        found = step(new, number).select(*start.columns).dropDuplicates(keys)
        new = save(without(found, united(parts), keys), "fixpoint")
        parts.append(new)
        if len(parts) > COMPACT:
            whole = save(united(parts[:-1]), "fixpoint")
            drop(*parts[:-1])
            parts = [whole, new]
    return united(parts)


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def without(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys none of known has."""
    own = dict(zip(keys, unused([f"own_{k}" for k in keys], rows.columns)))
    side, same = known.select(*[F.col(k).alias(name) for k, name in own.items()]), F.lit(True)
    for k, name in own.items():
        same &= F.col(k).eqNullSafe(F.col(name))
    return rows.join(side, same, "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, hops): the nodes that seeds (node) lead to over edges (src, dst), with the least number of them; seeds have none. A
    node with very many edges is a hot key of the join with few new nodes, which is broadcast or split by adaptive execution."""
    kept = save(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "fixpoint-edges")

    def step(new: DataFrame, number: int) -> DataFrame:
        return new.join(kept, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(number).cast("long").alias("hops"))

    found = fixpoint(seeds.select("node", F.lit(0).cast("long").alias("hops")), step, ["node"], rounds)
    drop(kept)
    return found
