"""MinHash near-duplicate removal by a chosen-path set similarity join, with exact confirmation.

Two documents are linked if the Jaccard similarity of their sets of word shingles (four words in lower case; a shorter text being
one shingle) is at least the threshold. Of each connected component the document of the smallest id is kept.

1. Texts. Documents with the same shingles in the same order are one text. Each has PLACES MinHashes, the tokens that stand for it.
2. Trees. The root of a tree holds all texts. A node chooses 1 / threshold of the places (a whole number by a hash of its path, and
   one more for the rest of it, by chance), and every text goes to the child of its token at each chosen place. So a text has
   few children, texts at the threshold have about one child in common on each level however deep the tree is, and texts that
   have little in common part at once. A text's path needs no other text: the first levels are computed where its tokens are.
3. Nodes. Those of at most BLOCK texts are compared exhaustively, by a bit of each MinHash, with a margin of some standard
   deviations; one edge per merge (not per pair) is emitted. Larger ones branch again, with LEVELS as the depths at which they are
   counted. The number of trees, all of them independent, makes a pair at the threshold meet at the last depth with the target
   recall (`trees_for`); a pair that meets in a smaller node on the way meets with a higher one.
4. Components of the edges, then confirmation: all texts of a component are compared by their whole shingle sets
   (`jaccard_join.verify`), and the links found make the components of the result.

Large groups of near copies would stay together on any path. A node with more than BLOCK texts therefore has a pivot: texts near it
are joined to it, need no comparison with each other, and go down only in company of texts that are not near. What is still
large at the last depth is cut into blocks that meet block by block. No pair is emitted as a row, no node is collected whole.

Defined results: a null or empty text has no shingles, is linked with nothing and kept. Repeated rows are copies: all those that
have the smallest id are kept. Null ids come first. A very long text is hashed whole, in memory of some bytes a character. An
empty table gives an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, save
from .jaccard_join import Sets, byte_batches, close, deal, differing, gram_hashes, join_texts, min_hashes, mix, row_key, runs

GRAM = 4
THRESHOLD = 0.8
PLACES = 256  # a power of two
RECALL = 0.9999
LEVELS = (2, 4, 6)
BLOCK = 2000  # texts of a node that are compared in one task
SHARE = 16  # one of so many texts is looked at to find larger nodes
SMALL = 256  # texts of a node of which all pairs are compared at once
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)


def survival(agree: float, threshold: float, levels: int) -> float:
    """The chance that two texts, of whose MinHashes this share agrees, have a path of so many levels in common in one tree."""
    part, whole = math.modf(1 / threshold)
    apart = 0.0
    for _ in range(levels):
        one = 1 - agree + agree * apart
        apart = one**whole * (1 - part + part * one)
    return 1 - apart


def trees_for(threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS[-1], places: int = PLACES) -> int:
    """The trees in which a pair at the threshold meets with this probability, over all shares of MinHashes that may agree."""
    terms = [math.lgamma(places + 1) - math.lgamma(k + 1) - math.lgamma(places - k + 1) + k * math.log(threshold) + (places - k) * math.log1p(-threshold) for k in range(places + 1)]
    chances = [(math.exp(t), 1 - survival(k / places, threshold, levels)) for k, t in enumerate(terms)]
    trees = 1
    while sum(p * miss**trees for p, miss in chances) > 1 - recall:
        trees += 1
    return trees


def signatures(docs: DataFrame, key: str, gram: int = GRAM) -> DataFrame:
    """(row, key, h1, h2, size, tokens) of each row: row is its number, h1 and h2 identify its sequence of shingles (null: none),
    size is that of its set, tokens are its MinHashes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for keys, texts in byte_batches(rows):
            grams = [gram_hashes(t, gram) for t in texts]
            names = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None for g in grams]
            sets = {n: np.unique(g) for n, g in zip(names, grams) if n is not None}
            tokens: dict[bytes, bytes] = {}
            if sets:
                made = min_hashes(np.concatenate(list(sets.values())), np.fromiter(map(len, sets.values()), np.int64, len(sets)), PLACES)
                tokens = {n: x.tobytes() for n, x in zip(sets, made)}
            half = lambda i: pa.array([n and int.from_bytes(n[i : i + 8], "little", signed=True) for n in names], pa.int64())
            sizes = pa.array([len(sets[n]) if n else 0 for n in names], pa.int64())
            own = pa.array(np.arange(number, number + len(names)))
            number += len(names)
            yield pa.RecordBatch.from_arrays([own, keys, half(0), half(8), sizes, pa.array([tokens.get(n) for n in names], pa.binary())], ["row", "key", "h1", "h2", "size", "tokens"])

    return docs.select(key, "text").mapInArrow(run, f"row long, key {kind}, h1 long, h2 long, size long, tokens binary")


def grow(paths: np.ndarray, owner: np.ndarray, tokens: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths so many levels below, their owners' places in tokens, and the numbers of the paths that they continue."""
    part, whole = math.modf(1 / threshold)
    origin, places = np.arange(len(paths)), np.uint64(tokens.shape[1])
    for _ in range(levels):
        more = (mix(paths + GOLDEN) >> np.uint64(11)).astype(float) * 2.0**-53 < part
        count = int(whole) + more
        up = np.repeat(np.arange(len(paths)), count)
        nth = (np.arange(len(up)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        draw = mix(paths * ODD + np.uint64(1))[up]
        place = (draw + nth * ((draw >> np.uint64(32)) | np.uint64(1))) % places  # an odd step: no place twice
        owner, origin = owner[up], origin[up]
        paths = mix(mix(draw + nth * GOLDEN) + tokens[owner, place.astype(np.intp)].astype(np.uint64) * ODD)
    return paths, owner, origin


def branch(rows: DataFrame, levels: int, threshold: float, trees: int | None = None) -> DataFrame:
    """(path, node, sketch, near) of the nodes so many levels below those of rows (node, tokens, paths, near: a list each); below the
    roots of so many trees for rows (node, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, PLACES)
                owner = np.arange(part.num_rows)
                if trees:
                    paths, owner = np.tile(mix(np.arange(1, trees + 1, dtype=np.uint64)), part.num_rows), np.repeat(owner, trees)
                    near = np.zeros(len(paths), bool)
                else:
                    owner = np.repeat(owner, part.column(2).value_lengths().to_numpy())
                    paths, near = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                    paths = paths.view(np.uint64)
                paths, owner, origin = grow(paths, owner, tokens, levels, threshold)
                bits = np.packbits((tokens & 1).astype(np.uint8), axis=1).view(np.int64)[owner]
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), part.column(0).take(pa.array(owner)), sketch, pa.array(near[origin])], ["path", "node", "sketch", "near"])

    return rows.mapInArrow(run, "path long, node long, sketch array<long>, near boolean")


def a_share(rows: DataFrame) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(SHARE)) == 0)


def large_nodes(some: DataFrame) -> DataFrame:
    """(path, pivot, of_pivot: its sketch) of nodes with over BLOCK texts, by the count of a share of their rows; saved. A pivot is
    one of the texts that are joined already, where the share has one."""
    pivot = F.min(F.struct(~F.col("near"), F.col("node"), F.col("sketch"))).alias("p")
    found = some.groupBy("path").agg(F.count("*").alias("n"), pivot).filter(F.col("n") * SHARE > BLOCK)
    return save(found.select("path", F.col("p.node").alias("pivot"), F.col("p.sketch").alias("of_pivot")), "paths-large")


def meet(bits: np.ndarray, most: int, joined: np.ndarray) -> Iterator[tuple[int, int]]:
    """Merges (i, j) of the texts of a node whose sketches are close, all compared with all. joined: those that are one set already."""
    n = len(bits)
    sets = Sets(n)
    if joined.any():
        sets.name[joined] = np.nonzero(joined)[0][0]
    if n <= SMALL:
        hit = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int32) <= most
        rows = ((i, i + 1 + np.nonzero(hit[i, i + 1 :])[0]) for i in np.nonzero(np.triu(hit, 1).any(axis=1))[0].tolist())
    else:
        rows = ((i, near_rows(bits, i, most, sets)) for i in range(n - 1))
    for i, near in rows:
        if len(near):
            for j in sets.join(i, near):
                yield i, j


def near_rows(bits: np.ndarray, i: int, most: int, sets: Sets) -> np.ndarray:
    """The later texts close to text i which aren't in its set."""
    later = np.arange(i + 1, len(bits))
    later = later[sets.name[later] != sets.name[i]]
    return later[np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1, dtype=np.int32) <= most]


def compared(rows: DataFrame, most: int) -> DataFrame:
    """(a, b), a < b: the merges of rows (path, pair, node, sketch, near), each path and pair of blocks by itself."""
    dealt = rows.select("path", "pair", "node", "sketch", "near").repartition("path", "pair").sortWithinPartitions("path", "pair", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches):
            if not bounds:
                continue
            keys, joined = table.column(2).to_numpy(), table.column(4).to_numpy()
            bits = table.column(3).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(keys), -1)
            out = []
            for a, b in bounds:
                if b - a == 2:
                    merges = [(0, 1)] if int(np.bitwise_count(bits[a] ^ bits[a + 1]).sum()) <= most else []
                else:
                    merges = meet(bits[a:b], most, joined[a:b])
                out += [sorted((keys[a + i], keys[a + j])) for i, j in merges if keys[a + i] != keys[a + j]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def edges(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: merges of texts (node, tokens) that meet in a node and have close sketches."""
    most, trees = close(PLACES, threshold), trees_for(threshold)
    zero = F.lit(0).cast("long")
    given, levels, found = texts.select("node", "tokens"), LEVELS[0], []
    for depth, following in zip(LEVELS, [*LEVELS[1:], None]):
        # Computed anew where they are read, which costs less than to keep them.
        rows = branch(given, levels, threshold, trees)
        hot = large_nodes(branch(a_share(given), levels, threshold, trees))
        if not hot.head(1):
            found.append(compared(rows.withColumn("pair", zero), most))
            break
        met = attach(rows, hot, ["path"], "node", "left")
        found.append(compared(met.filter("pivot IS NULL").withColumn("pair", zero), most))
        large = met.filter("pivot IS NOT NULL").withColumn("joined", F.col("near") | (differing("sketch", "of_pivot") <= most))
        star = large.filter("joined AND NOT near AND node <> pivot")
        found.append(star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
        # A node whose texts are all joined is done.
        far = F.sum((~F.col("joined")).cast("long"))
        sizes = save(large.groupBy("path").agg(far.alias("far"), F.count("*").alias("n")).filter("far > 0"), "paths-far")
        open_rows = attach(large.select("path", "node", "sketch", F.col("joined").alias("near")), sizes, ["path"], "node")
        if not sizes.head(1):
            break
        if following is None:
            blocks = lambda n: F.ceil(n / BLOCK)
            cut = open_rows.withColumns({"far_blocks": blocks(F.col("far")), "near_blocks": blocks(F.col("n") - F.col("far")), "far": ~F.col("near")})
            found.append(compared(deal(cut, "node"), most))
            break
        # A text's tokens are fetched once for all of its paths.
        lists = open_rows.groupBy("node").agg(F.collect_list("path").alias("paths"), F.collect_list("near").alias("near"))
        given, levels, trees = save(attach(texts.select("node", "tokens"), save(lists, "paths-down"), ["node"], "node"), "paths-down"), following - depth, None
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text)."""
    keyed = docs.select(row_key(docs).alias("id"), "text")
    found = join_texts(keyed, "id", threshold, gram, lambda rows: signatures(rows, "id", gram), edges, ("size",))
    own = F.col("key.doc_id")
    return found.select(own.alias("doc_id"), F.col("size").alias("n_shingles"), F.col("class_id").alias("component_id"), own.eqNullSafe(F.col("class_id")).alias("kept"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document, and whether it is the one that stays."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
