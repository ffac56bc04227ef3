"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

Two texts are linked if the Jaccard similarity of their sets of word n-grams (five words, a shorter text being one gram) is at
least the threshold. The result has a row per document: its class (the smallest id of its connected component) and the number
of documents that it is linked to.

1. Texts. Documents with the same grams in the same order (words compared in lower case; by a hash of 128 bits) are one text;
   copies are counted. A text goes by a number, that of one of its rows.
2. Forest. Each text has TREES * DEPTH MinHashes; a tree's trie is keyed by DEPTH of them in order, its labels. The shortest
   prefix is the longest one that a pair at the threshold shares, in some tree, with the target recall (`prefix_depth`).
   Rows (prefix, tail of further labels, text, sketch) are dealt by that prefix and sorted by prefix and tail, so that each
   task has whole subtries as sorted runs. Within one, matching begins at full depth and prefixes are shortened label by label,
   until all texts below are joined or the target recall is reached (`climb`). Texts that a shorter prefix brings together and
   that are not joined yet are compared by their sketch, a bit of each of SKETCH MinHashes, with a margin of some standard deviations;
   one edge per merge (not per pair) is emitted.
3. Components of these edges by alternating large and small stars, in the shared folder.
4. Verification. All texts of a component are compared exactly, by their whole gram sets. Only counts and merges leave a task.
   So the links that count are all pairs within a component: a pair missed by the forest is found if others connect it.

Large groups.
- A prefix with more than BLOCK texts (by the count of a share of the texts; it decides how work is dealt, not what is found) has
  a pivot: texts with a sketch near the pivot's are joined to it and need no comparison among each other. The others are cut into
  blocks by hash, and meet each other and the near ones block by block.
- A component of more than VERIFY_BLOCK texts has a pivot set: the grams that most of some of its texts have. A text is then what
  it lacks and adds. With a grams lacking, b added and s of both kinds in common with another text, the pair reaches threshold t
  exactly if a1 + a2 + t(b1 + b2) <= (1 - t) * pivot + (1 + t) * s. So pairs whose sum a + tb is within (1 - t) * pivot are linked
  whatever they have in common: a table of these numbers for each component, not of texts, counts them. Pairs beyond are
  compared by their differences, block by block; texts that no pair is beyond with are in no block. The pivot is no text's
  gram set, and any set gives the same result. A small component's pivot is the empty set, so it is compared whole.
Exact copies never meet: they are one text. No pair is emitted as a row. What is joined to the rows of a group is broadcast if
small, else dealt by a salt.

Defined results: a null or empty text has no grams; it is linked to nothing and is a class of its own. Repeated rows are
documents that are copies of each other. Null ids are ids that come first; where all ids of a class are null, so is its name.
A very long text is hashed whole, in memory of some bytes a character. An empty table gives an empty result. Other columns are
passed through by `keep_one`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import SALTS, attach, by_shuffle, drop, salt_mask, salted, salts_of, save

GRAM = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 16
SKETCH = 256  # bits, of as many MinHashes
RECALL = 0.9999
BLOCK = 2000  # rows of a prefix that are compared by sketch in one task
SHARE = 16  # one of so many texts is looked at to find the prefixes with more
VERIFY_BLOCK = 250  # texts of a component that are compared without a pivot
FAR_BLOCK = 1000  # texts of a larger one that are compared by their differences in one task, with as many others
PIVOT_TEXTS = 64  # of which a pivot is made, about
MARGIN = 6.0  # standard deviations of the sketch's estimate
BATCH_CHARS = 4_000_000
LOW = (1 << 63) - 1
UNIT = 1_000_000  # thresholds are integers, in units of which there are so many, so that a pair at the threshold itself isn't lost to rounding
LACKS = np.uint64(0xA5A5A5A5A5A5A5A5)  # tells a gram that is lacking from one that is added


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with at least this probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def gram_hashes(text: bytes, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of the word n-grams, in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_known) > 250_000:
        _known.clear()
    ids = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - gram + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(gram, len(ids))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return out


class Known(dict):
    """xxHash64 of words, kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_known = Known()


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def min_hashes(grams: np.ndarray, sizes: np.ndarray, count: int = TREES * DEPTH, seed: int = 3) -> np.ndarray:
    """(sets, count) of MinHashes of the concatenated sets, none of them empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), count), np.uint32)
    step = 1 << 15  # grams at a time, in the cache
    bounds = [0]
    for i, e in enumerate(np.cumsum(sizes)):
        if e - starts[bounds[-1]] > step and i > bounds[-1]:
            bounds.append(i)
    bounds.append(len(sizes))
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            part = low[starts[a] : starts[b - 1] + sizes[b - 1]]
            own = starts[a:b] - starts[a]
            for k in range(count):
                x = part * factors[k] + shifts[k]
                out[a:b, k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), own)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def tail_bits(depth: int) -> int:
    """How many bits of each label below a prefix of this depth a 64-bit tail has room for."""
    return min(32, 64 // max(1, DEPTH - depth))


def tails(labels: np.ndarray) -> np.ndarray:
    """The labels (last axis) below the shortest prefix in one number, so that its order is the trie's."""
    n = labels.shape[-1]
    bits = tail_bits(DEPTH - n)
    out = np.zeros(labels.shape[:-1], np.uint64)
    for k in range(n):
        out |= (labels[..., k] >> np.uint64(32 - bits)) << np.uint64(64 - bits * (k + 1))
    return out


def signatures(docs: DataFrame, key: str, gram: int = GRAM, depth: int | None = None) -> DataFrame:
    """(row, key, h1, h2, prefixes, tails, sketch) of each row: row is its number, h1 and h2 identify its sequence of grams (null: none)."""
    used = depth or prefix_depth()
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for keys, texts in byte_batches(rows):
            hashes = [gram_hashes(t, gram) for t in texts]
            names = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in hashes]
            sets = {n: np.unique(h) for n, h in zip(names, hashes) if n is not None}
            place = {n: i for i, n in enumerate(sets)}
            prefixes, below, sketches = np.empty((0, TREES), np.int64), np.empty((0, TREES), np.int64), np.empty((0, 0), np.int64)
            if sets:
                mins = min_hashes(np.concatenate(list(sets.values())), np.fromiter(map(len, sets.values()), np.int64, len(sets)))
                trees = mins.reshape(len(sets), TREES, DEPTH).astype(np.uint64)
                below = signed(tails(trees[:, :, used:]))
                code = np.broadcast_to(mix(np.arange(1, TREES + 1, dtype=np.uint64)), trees.shape[:2])
                for k in range(used):
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + trees[:, :, k])
                prefixes = signed(np.ascontiguousarray(code))
                sketches = np.packbits((mins[:, :SKETCH] & 1).astype(np.uint8), axis=1).view(np.int64)
            halves = [(None, None) if n is None else (int.from_bytes(n[:8], "little", signed=True), int.from_bytes(n[8:], "little", signed=True)) for n in names]
            lists = [pa.array([of[place[n]] if n is not None else None for n in names], pa.list_(pa.int64())) for of in (prefixes, below, sketches)]
            own = pa.array(np.arange(number, number + len(names)))
            number += len(names)
            yield pa.RecordBatch.from_arrays(
                [own, keys, *[pa.array([h[i] for h in halves], pa.int64()) for i in (0, 1)], *lists],
                ["row", "key", "h1", "h2", "prefixes", "tails", "sketch"],
            )

    return docs.select(key, "text").mapInArrow(run, f"row long, key {kind}, h1 long, h2 long, prefixes array<long>, tails array<long>, sketch array<long>")


def byte_batches(rows: Iterator[pa.RecordBatch], most: int = BATCH_CHARS) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(first column, bytes of the second) in runs of about so many bytes."""
    for batch in rows:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.column(0).slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.column(0).slice(start), texts[start:]


class Sets:
    """Disjoint sets of 0..n-1, as an array of each one's name."""

    def __init__(self, n: int) -> None:
        self.name = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Join i's set with those of others; one of the others from each set that was apart."""
        names, first = np.unique(self.name[others], return_index=True)
        apart = names != self.name[i]
        if not apart.any():
            return []
        old = np.append(names[apart], self.name[i])
        self.name[np.isin(self.name, old)] = old.min()
        return others[first[apart]].tolist()


def close(sketch_bits: int, threshold: float) -> int:
    """The most differing sketch bits of a pair at the threshold, with the margin."""
    p = (1 - threshold) / 2
    return int(sketch_bits * p + MARGIN * np.sqrt(sketch_bits * p * (1 - p)))


def starts(table: pa.Table) -> np.ndarray:
    """Where the runs of equal values of the first two columns begin."""
    keys = [table.column(i).to_numpy() for i in (0, 1)]
    new = np.ones(len(keys[0]), bool)
    new[1:] = (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)
    return np.nonzero(new)[0]


def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by their first two columns, in tables of whole groups of these, with the bounds of those of two rows or more."""
    rest: pa.Table | None = None

    def bounded(table: pa.Table, at: np.ndarray) -> tuple[pa.Table, list[tuple[int, int]]]:
        ends = np.append(at[1:], table.num_rows)
        many = ends - at > 1
        return table, list(zip(at[many].tolist(), ends[many].tolist()))

    for batch in rows:
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([rest, part]) if rest is not None else part
        at = starts(part)
        if len(at) > 1:
            yield bounded(part.slice(0, int(at[-1])), at[:-1])
        rest = part.slice(int(at[-1])) if len(at) else None
    if rest is not None:
        yield bounded(rest, np.zeros(1, np.int64))


def deal(rows: DataFrame, member: str) -> DataFrame:
    """rows with `block` and `pair`, one for each pair of blocks that a row has to be in: two far blocks, or a far and a near one.

    Columns far (boolean), far_blocks, near_blocks: of the row's group, null for one that isn't cut.
    """
    far, near = F.col("far_blocks").cast("long"), F.col("near_blocks").cast("long")
    dealt = F.xxhash64(member, F.lit(11))
    at_least = lambda k: F.greatest(k, F.lit(1).cast("long"))
    own = F.when(F.col("far"), F.pmod(dealt, at_least(far))).otherwise(far + F.pmod(dealt, at_least(near)))
    rows = rows.withColumn("block", F.coalesce(own, F.lit(0).cast("long")))
    last = F.when(F.col("far"), far + near).otherwise(far) - 1
    others = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    number = lambda j: F.least(j, F.col("block")) * (far + near) + F.greatest(j, F.col("block"))
    pairs = F.when(far.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, number))
    return rows.withColumn("pair", F.explode(pairs))


def climb(bits: np.ndarray, tail: np.ndarray, most: int, depth: int, joined: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Merges (i, j) of the texts below one shortest prefix, of that depth, sorted by tail: their sketches are close. joined: a
    mask of texts that are one set from the beginning.

    From full depth upwards each prefix is a run of equal leading labels. The runs one label deeper are done by then, so a text
    is compared with those of later such runs only, less those that are joined to it already.
    """
    n, labels = len(bits), DEPTH - depth
    sets, step = Sets(n), tail_bits(depth)
    if joined is not None and joined.any():
        sets.name[joined] = np.nonzero(joined)[0][0]
    inner = np.arange(1, n + 1)  # the end of each text's run one label deeper
    for left in range(labels, -1, -1):
        key = tail.view(np.uint64) >> np.uint64(64 - step * left) if left else np.zeros(n, np.uint64)
        outer = np.searchsorted(key, key, side="right")
        for i in np.nonzero(outer > inner)[0].tolist():
            later = np.arange(inner[i], outer[i])
            later = later[sets.name[later] != sets.name[i]]
            if len(later):
                near = later[np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1, dtype=np.int32) <= most]
                for j in sets.join(i, near) if len(near) else ():
                    yield i, j
        if (sets.name == sets.name[0]).all():  # all are one: no shorter prefix is needed
            return
        inner = outer


def hot_prefixes(rows: DataFrame, most: int) -> DataFrame | None:
    """(prefix, pivot, of_pivot: its sketch, far_blocks, near_blocks) of prefixes with over BLOCK texts, saved; None without any. See above."""
    some = rows.filter(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(SHARE)) == 0)
    pivot = F.min(F.struct("node", "sketch")).alias("p")
    hot = some.groupBy("prefix").agg(F.count("*").alias("n"), pivot).filter(F.col("n") * SHARE > BLOCK)
    hot = save(hot.select("prefix", F.col("p.node").alias("pivot"), F.col("p.sketch").alias("of_pivot")), "join-prefixes")
    if not hot.head(1):
        return None
    far = (differing("sketch", "of_pivot") > most).cast("long")
    sizes = attach(rows, hot, ["prefix"], "node").groupBy("prefix").agg(F.sum(far).alias("n"), F.count("*").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK)
    sizes = sizes.select(F.col("prefix").alias("__p"), blocks(F.col("n")).alias("far_blocks"), blocks(F.col("all") - F.col("n")).alias("near_blocks"))
    return save(hot.join(by_shuffle(sizes), F.col("prefix") == F.col("__p")).drop("__p"), "join-prefixes")


def differing(a: str, b: str) -> Column:
    """The bits in which two sketches differ."""
    words = SKETCH // 64
    each = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(words)]
    return sum(each[1:], each[0])


def forest_edges(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: merges of texts (node, prefixes, tails, sketch) that share a prefix and have close sketches."""
    most, depth = close(SKETCH, threshold), prefix_depth(threshold)
    # A signed number sorts like its bits do once the top one is turned.
    zipped = F.explode(F.arrays_zip("prefixes", F.transform("tails", lambda t: t.bitwiseXOR(F.lit(-LOW - 1))).alias("tails")))
    rows = texts.select(zipped.alias("at"), "node", "sketch").select(F.col("at.prefixes").alias("prefix"), F.col("at.tails").alias("tail"), "node", "sketch")
    hot, near = hot_prefixes(rows, most), None
    if hot is None:
        dealt = rows.withColumn("pair", F.lit(0).cast("long")).withColumn("near", F.lit(False))
    else:
        met = attach(rows, hot, ["prefix"], "node", "left").withColumn("far", differing("sketch", "of_pivot") > most)
        near = met.filter("NOT far AND node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        dealt = deal(met, "node").withColumn("near", F.coalesce(~F.col("far"), F.lit(False)))
    dealt = dealt.select("prefix", "pair", "tail", "node", "sketch", "near").repartition("prefix", "pair").sortWithinPartitions("prefix", "pair", "tail", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches):
            if not bounds:
                continue
            tail, keys = table.column(2).to_numpy() ^ (-LOW - 1), table.column(3).to_numpy()
            bits = table.column(4).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(keys), -1)
            joined = table.column(5).to_numpy()
            out_a, out_b = [], []
            for a, b in bounds:
                if b - a == 2:
                    merges = [(0, 1)] if int(np.bitwise_count(bits[a] ^ bits[a + 1]).sum()) <= most else []
                else:
                    merges = climb(bits[a:b], tail[a:b], most, depth, joined[a:b])
                for i, j in merges:
                    x, y = sorted((keys[a + i], keys[a + j]))
                    if x != y:
                        out_a.append(x)
                        out_b.append(y)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    found = dealt.mapInArrow(run, "a long, b long")
    return (found if near is None else found.union(near)).distinct()


def components(edges: DataFrame, name: str = "component-edges") -> DataFrame:
    """(node, root) of the nodes of edges (a, b), saved: root is the smallest node of the component. Alternating stars."""
    now = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node's neighbours are dealt by a salt too; its minimum goes to the salts that it has.
        both = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        parts = both.groupBy("a", "s").agg(F.min("b").alias("m"))
        least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_set("s").alias("salts"))
        least = least.select(F.col("a").alias("u"), F.least("a", "m").alias("m"), F.explode("salts").alias("z"))
        # Large star: neighbours above a node point to the smallest of all its neighbours and itself.
        large = both.filter("b > a").join(by_shuffle(least), (F.col("a") == F.col("u")) & (F.col("s") == F.col("z"))).select(F.col("m").alias("a"), "b").distinct()
        # Small star: neighbours below a node, and itself, point to the smallest.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(by_shuffle(low.withColumnRenamed("b", "u")), F.col("b") == F.col("u"))
        small = small.select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).filter("a < b").select("a", "b").distinct()
        new = save(small, name)
        # Done when each node has one edge, to a node that has none itself.
        shape = new.agg(F.count("*").alias("n"), F.count_distinct("b").alias("d")).first()
        drop(now)
        now = new
        if shape["n"] == shape["d"] and not new.join(by_shuffle(new.select(F.col("b").alias("x"))), F.col("a") == F.col("x"), "left_semi").head(1):
            break
    found = save(now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), name)
    drop(now)
    return found


def linked_pairs(sets: list[np.ndarray], weight: np.ndarray, budget: int, left: np.ndarray, right: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, j array): a left member and the right ones that it is linked with by what they share (left is right: each pair once).

    sets: of differences, weight: their sums; see above. What two members share is counted over the elements that several have: by
    bitmaps where these are dense, else by an inverted index from elements to members.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    same = left is right
    grams, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    use = shared[places]
    gram, owner = number[places[use]], owner[use]
    width = int(shared.sum()) // 8 + 1
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    dense = float(counts[shared].astype(float) @ counts[shared]) * 4 > len(left) * len(right) * width / 8 and len(sets) * width < 64_000_000
    if dense:
        words = -(-width // 8)
        bits = np.zeros((len(sets), words * 8), np.uint8)
        np.bitwise_or.at(bits, (owner, gram >> 3), (1 << (gram & 7)).astype(np.uint8))
        rows = bits.view(np.uint64)
        other = rows[right]
    else:
        mine = np.isin(owner, right)
        order = np.argsort(gram[mine], kind="stable")
        posting, who = gram[mine][order], np.searchsorted(right, owner[mine][order])
    for n, i in enumerate(left.tolist()):
        if dense:
            common = np.bitwise_count(other & rows[i]).sum(axis=1, dtype=np.int64)
        else:
            own = gram[cuts[i] : cuts[i + 1]]
            lo, hi = np.searchsorted(posting, own), np.searchsorted(posting, own, side="right")
            wide = hi - lo
            at = np.repeat(lo - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
            common = np.bincount(who[at], minlength=len(right))
        beyond = weight[i] + weight[right] - budget
        hit = (beyond > 0) & (common * (UNIT + limit) >= beyond)
        if same:
            hit[: n + 1] = False
        if hit.any():
            yield i, right[np.nonzero(hit)[0]]


def differences(members: DataFrame, limit: int, gram: int = GRAM) -> DataFrame:
    """(root, node, copies, large, w, budget, d) of members (root, node, copies, large, text, pivot: sorted gram hashes, null for none)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        raw, pivot = None, none
        for batch in rows:
            weights, budgets, made = [], [], []
            for text, given in zip(batch.column(4).cast(pa.binary()), batch.column(5)):
                grams = np.unique(gram_hashes(text.as_py() or b"", gram))
                if (given := given.as_py()) != raw:
                    raw, pivot = given, np.frombuffer(given, np.uint64) if given else none
                added, lacking = grams, none
                if len(pivot):
                    at = np.minimum(np.searchsorted(pivot, grams), len(pivot) - 1)
                    both, left = pivot[at] == grams, np.ones(len(pivot), bool)
                    left[at[both]] = False
                    added, lacking = grams[~both], pivot[left]
                weights.append(UNIT * len(lacking) + limit * len(added))
                budgets.append((UNIT - limit) * len(pivot))
                made.append(np.concatenate([mix(lacking ^ LACKS), added]).tobytes())
            columns = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weights, pa.int64()), pa.array(budgets, pa.int64()), pa.array(made, pa.binary())], ["root", "node", "copies", "large", "w", "budget", "d"])

    return members.select("root", "node", "copies", "large", "text", "pivot").mapInArrow(run, "root long, node long, copies long, large boolean, w long, budget long, d binary")


def pivots(members: DataFrame, gram: int = GRAM) -> DataFrame:
    """(root, pivot) of the large components of members (root, node, texts: of the component, text): the grams that most of about
    PIVOT_TEXTS of its texts have, chosen by hash."""

    def most(part: pd.DataFrame) -> pd.DataFrame:
        grams, counts = np.unique(np.concatenate([np.unique(gram_hashes((t or "").encode(), gram)) for t in part["text"]]), return_counts=True)
        return pd.DataFrame({"root": part["root"].iloc[:1], "pivot": [grams[2 * counts > len(part)].tobytes()]})

    some = members.filter(F.pmod(F.xxhash64("node", F.lit(19)), F.col("texts")) < PIVOT_TEXTS)
    return some.select("root", "text").groupBy("root").applyInPandas(most, "root long, pivot binary")


def within(part: pd.DataFrame, block: int) -> pd.DataFrame:
    """Rows (root, budget, w, copies, n), a component's texts by weight, to (root, w, linked: copies of all texts with which the sum
    of weights is within the budget, far, used: in some pair beyond it, far_blocks, near_blocks: of so many texts)."""
    part = part.sort_values("w")
    w, copies, n, budget = part["w"].to_numpy(), part["copies"].to_numpy(), part["n"].to_numpy(), int(part["budget"].iloc[0])
    upto = np.append(0, np.cumsum(copies))
    far = 2 * w > budget
    near = ~far & (w + w[-1] > budget)
    blocks = [-(-int(n[x].sum()) // block) for x in (far, near)]
    return pd.DataFrame({"root": part["root"], "w": w, "linked": upto[np.searchsorted(w, budget - w, side="right")], "far": far, "used": far | near, "far_blocks": blocks[0], "near_blocks": blocks[1]})


def verify(members: DataFrame, threshold: float, gram: int = GRAM) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """members: (root, node, copies, texts: of the component if it is large, else null, text) of whole components, saved. Returns
    merges (a, b); parts of link counts (node, links): of documents of other texts that a text's are linked to; and the saved
    tables that these two read."""
    limit = round(threshold * UNIT)
    large = members.filter("texts IS NOT NULL")
    sided = members.withColumn("large", F.col("texts").isNotNull())
    any_large = bool(large.head(1))
    if any_large:
        found = save(pivots(large, gram), "join-pivots")
        sided = attach(sided, found, ["root"], "node", "left")
    else:
        sided = sided.withColumn("pivot", F.lit(None).cast("binary"))
    made = save(differences(sided, limit, gram), "join-differences")
    whole = made.filter("NOT large").withColumns({"block": F.lit(0).cast("long"), "pair": F.lit(0).cast("long")})
    merges, links, kept, columns = None, None, [], ["root", "pair", "block", "node", "copies", "w", "budget", "d"]
    rows = whole.select(columns)
    if any_large:
        # A row may be there twice (its document is), so texts are taken once.
        weighed = save(made.filter("large").select("root", "node", "copies", "w", "budget").distinct(), "join-weights")
        table = weighed.groupBy("root", "budget", "w").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
        block = FAR_BLOCK
        table = table.groupBy("root").applyInPandas(lambda part: within(part, block), "root long, w long, linked long, far boolean, used boolean, far_blocks long, near_blocks long")
        table = save(table, "join-table")
        centre = weighed.groupBy("root").agg(F.min(F.struct("w", "node")).alias("c")).select("root", F.col("c.w").alias("least"), F.col("c.node").alias("centre"))
        centre = save(centre, "join-centres")
        star = attach(weighed, centre, ["root"], "node").filter("w + least <= budget AND node <> centre")
        merges = star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        own = F.when(F.col("w") * 2 <= F.col("budget"), F.col("copies")).otherwise(0)
        links = attach(weighed, table.select("root", "w", "linked"), ["root", "w"], "node").select("node", (F.col("linked") - own).alias("links"))
        far = attach(made.filter("large"), table.drop("linked").filter("used"), ["root", "w"], "node")
        rows = rows.union(deal(far, "node").select(columns))
        kept = [weighed, table, centre]
    dealt = rows.repartition("root", "pair").sortWithinPartitions("root", "pair", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches):
            block, node, copies, weight, budget = (table.column(i).to_numpy() for i in range(2, 7))
            raw = table.column(7)
            out = []
            for a, b in bounds:
                once = np.append(True, np.diff(node[a:b]) != 0).nonzero()[0] + a
                sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in once]
                own = block[once]
                left, right = np.nonzero(own == own[0])[0], np.nonzero(own != own[0])[0]
                right = right if len(right) else left
                links, joined = np.zeros(len(once), np.int64), Sets(len(once))
                for i, js in linked_pairs(sets, weight[once], int(budget[a]), left, right, limit):
                    links[i] += copies[once[js]].sum()
                    links[js] += copies[once[i]]
                    for j in joined.join(i, js):
                        out.append((*sorted((int(node[once[i]]), int(node[once[j]]))), None))
                out += [(int(node[once[i]]), None, int(links[i])) for i in np.nonzero(links)[0]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "links"])

    checked = save(dealt.mapInArrow(run, "a long, b long, links long"), "join-verified")
    met, counted = checked.filter("b IS NOT NULL").select("a", "b"), checked.filter("b IS NULL").select(F.col("a").alias("node"), "links")
    drop(made)
    return (met, counted, [checked]) if merges is None else (met.union(merges), counted.union(links), [checked, *kept])


def join_texts(
    docs: DataFrame,
    key: str,
    threshold: float = THRESHOLD,
    gram: int = GRAM,
    sign: Callable[[DataFrame], DataFrame] | None = None,
    edges: Callable[[DataFrame, float], DataFrame] | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """(key, first, class_id, links) of each row. first: the least key of its class (null: the text has no grams), links: to
    documents of other texts and to copies. Keys are structs whose first field is doc_id, the same for rows of one text only.

    sign makes rows (row, key, h1, h2 and more) of docs, edges (a, b) of the texts (node and the same more), instead of the
    forest's; columns of sign's named in `also` are passed on."""
    sign = sign or (lambda rows: signatures(rows, key, gram, prefix_depth(threshold)))
    signed_rows = save(sign(docs), "join-signatures")
    texts = signed_rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("copies"), salt_mask("row").alias("salts"))
    texts = save(texts, "join-texts")
    own = signed_rows.join(by_shuffle(texts.select("node")), F.col("row") == F.col("node"), "left_semi")
    own = save(own.drop("key", "h1", "h2", *also).withColumnRenamed("row", "node"), "join-forest")
    slim = save(signed_rows.select("row", "key", "h1", "h2", *also), "join-rows")  # the signatures go before texts are dealt
    drop(signed_rows)
    signed_rows = slim
    found = components((edges or forest_edges)(own, threshold), "join-components")
    drop(own)
    # One document's text for each text of a component.
    sizes = save(found.groupBy("root").agg(F.count("*").alias("texts")).filter(F.col("texts") > VERIFY_BLOCK), "join-large")
    chosen = attach(found, sizes, ["root"], "node", "left")
    chosen = by_shuffle(chosen).join(by_shuffle(texts.select(F.col("node").alias("__n"), "copies")), F.col("node") == F.col("__n"))
    chosen = save(by_shuffle(chosen).join(by_shuffle(signed_rows.select("row", "key")), F.col("node") == F.col("row")).select("key", "root", "node", "copies", "texts"), "join-chosen")
    members = save(attach(docs.select(F.col(key).alias("key"), "text"), chosen, ["key"], "key"), "join-members")
    merges, counts, kept = verify(members, threshold, gram)
    classes = components(merges, "join-merges")
    links = counts.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    of_text = texts.join(by_shuffle(classes.withColumnRenamed("node", "__n")), F.col("node") == F.col("__n"), "left").join(by_shuffle(links), F.col("node") == F.col("linked"), "left")
    several = of_text.filter("root IS NOT NULL OR copies > 1").select(
        F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.coalesce("root", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.explode(salts_of("salts")).alias("z")
    )
    rows = signed_rows.select("row", "key", "h1", "h2", *also).join(by_shuffle(several), (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")) & (salted("row") == F.col("z")), "left")
    rows = save(rows.select("row", "key", *also, F.col("h1").isNull().alias("blank"), "class", F.coalesce("links", F.lit(0)).alias("links")), "join-rows")
    drop(signed_rows, texts, found, sizes, chosen, members, classes, *kept)
    names = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("first"), F.min("key.doc_id").alias("class_id"), salt_mask("row").alias("salts"))
    names = names.select(F.col("class").alias("c"), "first", "class_id", F.explode(salts_of("salts")).alias("z"))
    named = rows.join(by_shuffle(names), (F.col("class") == F.col("c")) & (salted("row") == F.col("z")), "left")
    alone = F.col("class").isNull()
    return named.select(
        "key",
        F.when(alone & ~F.col("blank"), F.col("key")).otherwise(F.col("first")).alias("first"),
        F.when(alone, F.col("key.doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "links",
        *also,
    )


def row_key(docs: DataFrame) -> Column:
    """What stands for a row: its id and a hash of its text, the same wherever it is computed."""
    return F.struct("doc_id", F.xxhash64("text").alias("h"))


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of docs (doc_id, text)."""
    found = join_texts(docs.select(row_key(docs).alias("id"), "text"), "id", threshold)
    return found.select(F.col("key.doc_id").alias("doc_id"), "class_id", F.col("links").alias("n_links"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document stays, that of the smallest id. Texts without words all stay."""
    found = save(join_texts(docs.select(row_key(docs).alias("id"), "text"), "id").select("key", "first"), "join-firsts")
    gone = save(found.filter("key <> first").select("key").distinct(), "join-gone")
    twice = save(found.filter("key = first").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "join-twice")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(docs).alias("key"))
    kept = own.join(listed(gone), F.col("key") == F.col("__key"), "left_anti")
    if twice.head(1):  # the same row several times
        once = kept.join(listed(twice), F.col("key") == F.col("__key"), "left_semi").dropDuplicates(["key"])
        kept = kept.join(listed(twice), F.col("key") == F.col("__key"), "left_anti").union(once)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def listed(keys: DataFrame) -> DataFrame:
    """Keys to join with, broadcast if few."""
    side = keys.select(F.col("key").alias("__key"))
    return F.broadcast(side) if keys.count() <= common.BROADCAST_ROWS else by_shuffle(side)
