"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

Documents are dealt by a hash of id and cluster into packing groups of about GROUP rows (their number follows the row count), so
a hot source or a large cluster of copies is spread over all groups, and a task's memory is bounded. Rows of groups that have over
twice as many (the same row very often) are dealt anew by their place in the table. Within a group, documents go in order of
falling length. A bin has its residual, and a bitmap of the sources and of the duplicate clusters that it holds; at most one
document of each may be in a bin. Bins are ordered by residual: the search begins at the successor of the document's length
and goes on to the next larger residual until a bin without a conflict is found, the tightest compatible one; else a new bin is
opened. A longer document than the capacity is cut: each full part fills a bin of its own, and the rest is packed. Nothing is
dropped.

Defined results: a document without words (null, empty) has one row, of length 0 and null bin. A null source conflicts with
nothing. Repeated rows are documents of one cluster, so they never share a bin. Ties in length go by id (nulls first), then
text hash. An empty table gives an empty result. A very long text becomes as many parts as it fills. Other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, save, words

CAPACITY = 2048
GROUP = 4000


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each item (length up to capacity, source, cluster) in the given order; None conflicts with nothing."""
    items = list(items)
    several = {c for c, n in Counter(c for _, _, c in items if c is not None).items() if n > 1}
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    order: list[tuple[int, int]] = []  # (residual, bin) of the bins with room
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster in several else 0
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, own = order.pop(at)
        else:
            residual, own = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[own] |= s
        clusters[own] |= c
        if residual > length:
            insort(order, (residual - length, own))
        out.append(own)
    return out


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Rows (group, doc_id, source, cluster, n) of one packing group to parts in bins."""
    group = int(rows["group"].iloc[0])
    table = [
        (int(n), None if pd.isna(d) else int(d), None if pd.isna(s) else s, None if pd.isna(c) else int(c))
        for n, d, s, c in zip(rows["n"], rows["doc_id"], rows["source"], rows["cluster"])
    ]
    table.sort(key=lambda r: (-(r[0] % capacity), r[1] is not None, r[1] or 0, r[3] or 0, str(r[2])))
    rest = [r for r in table if r[0] % capacity]
    bins = best_fit([(n % capacity, s, c) for n, _, s, c in rest], capacity)
    used = max(bins, default=-1) + 1
    filled: Counter[int] = Counter()
    members: Counter[int] = Counter()
    out = []
    for (n, d, _, _), own in zip(rest, bins):
        out.append((d, n // capacity, own, members[own], filled[own], n - n % capacity, n % capacity))
        members[own] += 1
        filled[own] += n % capacity
    for n, d, _, _ in table:
        for part in range(n // capacity):
            out.append((d, part, used, 0, 0, part * capacity, capacity))
            used += 1
        if not n:
            out.append((d, 0, None, 0, 0, 0, 0))
    frame = pd.DataFrame(out, columns="doc_id part bin slot bin_start doc_start length".split())
    frame["bin_id"] = (frame["bin"].astype("Int64") + group * (1 << 24)).astype("Int64")
    return frame.astype({"doc_id": "Int64"})[["doc_id", "part", "bin_id", "slot", "bin_start", "doc_start", "length"]]


def cluster_of(text: Column) -> Column:
    """The duplicate cluster of a text: a hash of its words in lower case."""
    return F.xxhash64(F.lower(F.array_join(words(text), " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster: str | None = None) -> DataFrame:
    """Rows (doc_id, part, bin_id, slot, bin_start, doc_start, length) of docs (doc_id long, text, source), counted in words.

    cluster: a column of duplicate clusters (long) if docs have one; else equal texts are a cluster.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    own = F.col(cluster) if cluster else F.when(F.col("text").isNotNull(), cluster_of(F.col("text")))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), own.cast("long").alias("cluster"), F.size(words(F.col("text"))).alias("n"))
    rows = save(rows, "pack-lengths")
    groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", F.coalesce("cluster", F.lit(0))), F.lit(groups)))
    large = save(rows.groupBy("group").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * group), "pack-large")
    if spread := large.agg(F.sum("rows")).first()[0]:
        placed = rows.withColumn("place", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-spread // group))))
        rows = attach(placed, large, ["group"], "place", "left")
        rows = rows.withColumn("group", F.when(F.col("rows").isNull(), F.col("group")).otherwise(groups + F.col("place"))).drop("rows", "place")
    schema = "doc_id long, part int, bin_id long, slot int, bin_start int, doc_start int, length int"
    return rows.groupBy("group").applyInPandas(lambda part: pack_group(part, capacity), schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the bins of all documents."""
    return pack(docs.select("doc_id", "text", "source"))
