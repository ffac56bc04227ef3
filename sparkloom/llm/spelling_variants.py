"""Spelling variants: words that differ from another in one letter, grouped by rolling-hash deletions.

Words are runs of letters of all texts, a stated share of them with one letter taken out (which makes the variants to be found),
of a least length and count. Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's
form is its near word of the largest count, if that is large enough against the word's own; its root is where the forms lead.

1. Counts: summed per task, in parts of bounded size, then per word. Each word gets a number. Written to the shared folder.
2. Keys. A word's prefixes and suffixes have polynomial hashes (modulo 2^64, vectorised over all words of a batch); from the two
   around a letter follows the hash of the word without it. Letters of a run of equal ones give the same deletion, so a word
   has one row for each of its runs and one for itself: (key, number, place, length of the run), numbers only.
3. Rows are dealt by the key's leading bits and sorted by key. Runs of one row, most of them, go no further.
4. The others get their words, are dealt and sorted in the same way, and verified: words are together only if the deletions are
   equal as strings, whatever their hashes are. Those whose runs have a place in common differ by a replaced letter there; the
   word that equals the deletion differs from all others by a deleted one. Each pair of near words has exactly one such group, so a
   group passes on, for each of its words, how many others it has and the best of them (`linked`): no pairs.
5. Sums and the best per word; then forms are followed, each round doubling the steps, until no word has further to go.

A group has one deletion, so its words are that string with one of the 90 letters put in somewhere: its size is bounded by
the string's length, however many words there are. A word of very many letters has rows of some numbers, not of its letters.

Defined results: a null text has no words. A null id is hashed as an empty one. Repeated rows count again. Of near words of equal
counts the first in code-point order is the best. An empty table gives an empty result. Other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, save
from .jaccard_join import mix, runs

LETTERS = re.compile("[a-zÀ-ÿ]+")
TYPOS = 97  # one of so many runs (of a document and spelling) loses a letter
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2  # of a form's count to the word's, at least
PART = 300_000  # distinct words that a task counts before it passes them on
BATCH_LETTERS = 1_000_000
RADIX = 16  # leading bits of a key that rows are dealt by
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mutated(run: str, seed: int, typos: int = TYPOS) -> str:
    """The run, less one letter where typos divides the crc32 that begins with the seed's."""
    h = zlib.crc32(run.encode(), seed)
    if h % typos:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, typos: int = TYPOS, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters of at least this length after their letter is taken out."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in rows:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                seed = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                lower = (text.as_py() or b"").lower().decode("utf-8", "replace")  # of bytes: A-Z only
                for found, n in Counter(LETTERS.findall(lower)).items():
                    if len(found) >= least:
                        word = mutated(found, seed, typos)
                        if len(word) >= least:
                            counts[word] += n
                if len(counts) > PART:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """words with a number each, saved."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), *batch.columns], ["id", "word", "n"])
            at += batch.num_rows

    return save(words.select("word", "n").mapInArrow(run, "id long, word string, n long"), "variants-words")


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, place, length) of each word itself (place -1) and of each of its runs of equal letters: the hash of the word
    without one letter of the run, and where the run is."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - starts[owner]
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(sizes.max(initial=0)), BASE)))
    sums = np.append(np.uint64(0), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers[place]))
    # A prefix is what the sums grew by since the word's begin; a suffix moves down by one place once a letter before it goes.
    whole = sums[starts + sizes] - sums[starts]
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    at = np.nonzero(new)[0]
    of = owner[at]
    prefix, suffix = sums[at] - sums[starts[of]], sums[starts[of] + sizes[of]] - sums[at + 1]
    cut = prefix + suffix * INVERSE
    keys = np.concatenate([mix(whole + sizes.astype(np.uint64) * BASE), mix(cut + (sizes[of] - 1).astype(np.uint64) * BASE)])
    length = np.diff(np.append(at, len(letters)))
    return (
        np.concatenate([np.arange(len(words)), of]),
        keys,
        np.concatenate([np.full(len(words), -1), place[at]]),
        np.concatenate([np.zeros(len(words), np.int64), length]),
    )


def keyed(words: DataFrame) -> DataFrame:
    """(key, id, place, length) of words (id, word): see deletion_keys."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            start = size = 0
            for stop in range(1, len(texts) + 1):
                size += len(texts[stop - 1])
                if size >= BATCH_LETTERS or stop == len(texts):
                    owner, keys, place, length = deletion_keys(texts[start:stop])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), ids[start:stop][owner], place, length)], ["key", "id", "place", "length"])
                    start, size = stop, 0

    return words.select("id", "word").mapInArrow(run, "key long, id long, place long, length long")


def by_key(rows: DataFrame) -> DataFrame:
    """Rows of a key together, in order: dealt by the key's leading bits, sorted by key."""
    radix = F.shiftrightunsigned("key", 64 - RADIX)
    return rows.repartition(radix).sortWithinPartitions("key", "id")


def several(rows: DataFrame) -> DataFrame:
    """The rows (key, id, place, length) whose key others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before, and whether it went out
        gone = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            same = np.append(last is not None and last.column(0)[0].as_py() == int(keys[0]), keys[1:] == keys[:-1])
            if same[0] and not gone:
                yield last
            keep = same.copy()
            keep[:-1] |= same[1:]
            if keep.any():
                yield batch.filter(pa.array(keep))
            last, gone = batch.slice(batch.num_rows - 1), bool(keep[-1])

    return by_key(rows).mapInArrow(run, "key long, id long, place long, length long")


def linked(group: list[tuple[int, str, int, int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """(id, number of near words, count of the best, the best) for the words of a group (id, word, n, place, length) of equal hashes."""
    by_text: dict[str, list[tuple[int, str, int, int, int]]] = defaultdict(list)
    for row in group:
        place = row[3]
        by_text[row[1] if place < 0 else row[1][:place] + row[1][place + 1 :]].append(row)
    for members in by_text.values():
        if len(members) < 2:
            continue
        own = next((m for m in members if m[3] < 0), None)
        cut = sorted((m for m in members if m[3] >= 0), key=lambda m: (-m[2], m[1]))  # the best first
        if own and cut:
            yield own[0], len(cut), cut[0][2], cut[0][1]
            for m in cut:
                yield m[0], 1, own[2], own[1]
        begins = sorted({m[3] for m in cut})
        at: dict[int, list] = defaultdict(list)
        for m in cut:
            # Where two runs overlap, one of them begins.
            for b in begins[bisect_right(begins, m[3] - 1) : bisect_right(begins, m[3] + m[4] - 1)]:
                at[b].append(m)
        for together in at.values():
            if len(together) > 1:
                for i, m in enumerate(together):
                    best = together[0] if i else together[1]
                    yield m[0], len(together) - 1, best[2], best[1]


def links(rows: DataFrame) -> DataFrame:
    """(id, near, best_n, best) of rows (key, id, place, length, word, n), a row for each group that a word has near ones in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches):
            if not bounds:
                continue
            columns = [table.column(i).to_pylist() for i in (2, 5, 6, 3, 4)]
            out = [r for a, b in bounds for r in linked(list(zip(*(c[a:b] for c in columns))))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["id", "near", "best_n", "best"])

    # Runs are of equal first two columns.
    dealt = by_key(rows).select("key", F.lit(0).cast("long").alias("part"), "id", "place", "length", "word", "n")
    return dealt.mapInArrow(run, "id long, near long, best_n long, best string")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, root: its form): where the forms lead. Counts grow with each step, so there is an end. Words that
    are there leave the rounds; a word that many lead to is a hot key of the join, which adaptive execution splits."""
    done, open_ = None, save(forms, "variants-roots")
    while True:
        known = open_ if done is None else done.union(open_)
        side = known.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = save(open_.join(side, F.col("root") == F.col("at"), "left").select("word", "root", "next"), "variants-steps")
        there = step.filter("next IS NULL").select("word", "root")
        done = there if done is None else done.union(there)
        open_ = step.filter("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if not open_.head(1):
            return done


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    words = numbered(counts)
    shared = save(several(keyed(words)), "variants-keys")
    near = links(shared.join(words, "id")).groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    enough = -F.col("b.less") >= ratio * F.col("n")
    found = words.join(near, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("b.best")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")
    )
    found = save(found, "variants-forms")
    roots = followed(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    drop(words, shared)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, with the form and root of each."""
    counts = count_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return group_variants(counts.filter(F.col("n") >= LEAST_COUNT))
