"""Nearest vectors by cosine similarity: exact in blocks, or by an inverted file of cells.

Rows (id, vector) belong to the cell of their nearest centre; a query looks at the cells of its nearest few. Centres are fitted on a
stated number of rows (those of the least hashes), so they are a bounded model; every row is in the index. Within a cell
all similarities are computed exactly.

Cells differ in size, and one may have a third of all rows: a cell's rows and queries are cut into blocks, and each pair of blocks
is a group of bounded size that yields the best few of each of its queries. The exact search is the same with one cell for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIT_ROWS = 20_000
FIT_ROUNDS = 12
ROW_BLOCK = 20_000  # rows of a cell that one task compares with so many queries
QUERY_BLOCK = 2_000
HELD = 1_000_000  # similarities that a task holds at once
CELLED = 1_000  # rows that get their cells at once
DIGITS = 9  # to which similarities are compared: equal vectors tie whatever the order of sums


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal lengths as unit vectors; a zero vector stays one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    found = flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, size, out=np.zeros_like(found), where=size > 0)


def fit(rows: DataFrame, vector: str, cells: int, most: int = FIT_ROWS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centres by spherical k-means over so many rows at most."""
    some = rows.select(vector).filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector)).limit(most).toArrow()
    given = matrix(some.column(0).combine_chunks())
    centres = given[np.random.default_rng(1).permutation(len(given))[:cells]]
    for _ in range(rounds if len(centres) else 0):
        own = np.argmax(given @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, given)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def celled(rows: DataFrame, id: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(cell, id, vector) of the nearest so many cells of each row."""
    kind = rows.schema[id].dataType.simpleString()
    given = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CELLED):
                batch = whole.slice(start, CELLED)
                near = np.argsort(-(matrix(batch.column(1)) @ given.value.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "id", "vector"])

    return rows.filter(F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<double>")).mapInArrow(run, f"cell long, id {kind}, vector array<double>")


def best_of(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(query, id, score): the best k of rows for each of queries; of equal ones those of the least ids. So many similarities are held
    at once, whatever the block."""
    ids = rows.column("id").combine_chunks()
    order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
    given, asked = matrix(rows.column("vector").combine_chunks())[order], matrix(queries.column("vector").combine_chunks())
    k = min(k, len(given))
    best, found = np.empty((len(asked), k), np.int64), np.empty((len(asked), k))
    step = max(1, HELD // max(1, len(given)))
    for start in range(0, len(asked) if k else 0, step):
        scores = np.round(asked[start : start + step] @ given.T, DIGITS)
        np.negative(scores, out=scores)
        last = np.partition(scores, k - 1, axis=1)[:, k - 1]
        for i, (own, most) in enumerate(zip(scores, last), start):
            near = np.nonzero(~(own > most))[0]  # the k best and what ties with the last of them
            best[i] = near[np.argsort(own[near], kind="stable")[:k]]
            found[i] = -own[best[i]] + 0.0
    at = np.repeat(np.arange(len(asked)), k)
    return pa.table({"query": queries.column("id").combine_chunks().take(pa.array(at)), "id": ids.take(pa.array(order[best.ravel()])), "score": found.ravel()})


def search(rows: DataFrame, queries: DataFrame, id: str, vector: str, k: int, cells: int = 1, probes: int = 1) -> DataFrame:
    """(query, place, id, score): the k most similar rows of each query, from place 1; exact with one cell. Both have the columns id and
    vector, of equal lengths. Null vectors are neither found nor looked for. A query finds itself where it is one of the rows."""
    centres = fit(rows, vector, cells) if cells > 1 else np.zeros((1, 1))
    whole = cells <= 1 or not len(centres)
    blocks = lambda c, most: F.ceil(c / most).cast("int")
    if whole:
        inside, asked = (x.filter(F.col(vector).isNotNull()).select(F.lit(0).cast("long").alias("cell"), F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")) for x in (rows, queries))
        n, m = inside.count(), asked.count()
    else:
        inside, asked = celled(rows, id, vector, centres, 1), celled(queries, id, vector, centres, probes)
        sizes = inside.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
        sizes = F.broadcast(sizes.select(F.col("cell").alias("c"), blocks(F.col("n"), ROW_BLOCK).alias("a"), blocks(F.col("m"), QUERY_BLOCK).alias("b")))  # a row for each cell

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        if whole:
            met = side.withColumns({"a": blocks(F.lit(max(n, 1)), ROW_BLOCK), "b": blocks(F.lit(max(m, 1)), QUERY_BLOCK)})
        else:
            met = side.join(sizes, F.col("cell") == F.col("c"))
        met = met.withColumn(names[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return met.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("cell", "x", "y", "id", "vector")

    left, right = dealt(asked, "b", "a", ("y", "x")), dealt(inside, "a", "b", ("x", "y"))
    by = ["cell", "x", "y"]
    kind = rows.schema[id].dataType.simpleString()
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda q, r: best_of(q, r, k), f"query {kind}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("query", F.col("place").cast("long").alias("place"), "id", "score")
