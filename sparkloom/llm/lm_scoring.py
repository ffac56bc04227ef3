"""LM scoring by a hidden Markov language model trained by Baum-Welch.

Tokens are the words of a text (ASCII white space apart, A-Z in lower case) and one end. The model's latent states emit one of
CLASSES frequent words, the end, or one of BUCKETS groups of the other words, by their last letters and length. A word w of a group
has the further factor (c + 1) / Z, c being its count in training and Z the sum of c + 1 over the group's words plus 1 for an unseen
one. So every word's emission varies with the state, every count of the corpus takes part, and the score is a proper probability of
the whole sequence. The model's size is set by these two numbers, however many words there are.

Plan.
1. Counts of all training words: summed per task (spilling parts of bounded size), then per word. A word of over NAME_BYTES goes by
   a hash of 128 bits. Written to the shared folder.
2. The HOT most frequent words, a bounded dictionary, are broadcast. Each text becomes a row: its sums over hot words, its class
   sequence (2 bytes a token), and its rare words. Written to the shared folder.
3. Baum-Welch over all training sequences, each of them whole: exact forward and backward sums, single precision at a token and
   double over tokens, until a round raises the likelihood by less than GAIN a token. The first rounds are over a share of the
   sequences, which gives states to begin with at less cost; those over all of them end by the same rule. A task's expected counts go out as a row per class that it saw, are
   summed by class over all tasks, and reach the driver as one row per class: the model's size. Sequences of like lengths go
   side by side; of one with more than GROUP tokens only the sums at some places are kept, and the rest is computed again on
   the way back, so memory is bounded. Time is not: a sequence is one task's, step by step, some 30 microseconds a token and round
   where it is alone in its length, so a text of a million words holds its task for half a minute a round.
4. Rare words join the counts by shuffle. Hot keys cannot skew it, as they are hot words. Their sums go back to the row by its key.
5. The scaled forward recursion runs over whole sequences, many texts side by side.

Defined results: null text is the empty text, one end token. A null id is not held out. Repeated rows are scored one by one.
With nothing to learn from, N and V are 0. An empty table gives an empty result. A very long text is one sequence, whole in
training and scoring. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, save

CLASSES = 24_000
BUCKETS = 8_000
STATES = 16
STICK = 0.9  # of the first transitions: the weight of staying in a state, without which training lingers where all states are alike
PRIOR = 100  # words, dealt as in the corpus, that each state is taken to have emitted besides its own
GAIN = 0.002  # of log10 likelihood a token; a round that gains less is the last
HOT = 80_000
NAME_BYTES = 64
PART = 150_000  # distinct words that a task counts before it passes them on
SHARE = 8  # one of so many sequences is learned from first, until that gains little; all of them follow, until that does
TASKS = 3  # of a round, for each core
GROUP = 200_000  # tokens whose sums are held side by side
SIDE = 64  # sequences side by side at least, however long
BUFFER = 2_000_000  # tokens that are sorted by length before they are grouped
BATCH = 1_000_000  # tokens scored side by side
ROWS = 1_000  # texts or sequences that a task unpacks at once
LOG10 = np.log(10)


def tokens(text: bytes | None) -> list[bytes]:
    """The words; bytes.split() takes the ASCII white space, bytes.lower() A-Z only."""
    return (text or b"").lower().split()


def name_of(word: bytes) -> bytes:
    """The word, or what stands for a long one; 0xFF begins no UTF-8."""
    return word if len(word) <= NAME_BYTES else b"\xff" + hashlib.blake2b(word, digest_size=16).digest()


def bucket(word: bytes, buckets: int) -> int:
    """The group of a word that has no emission of its own: by its last three bytes and its length."""
    return zlib.crc32(word[-3:] + bytes([min(len(word), 15)])) % buckets


def as_bytes(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROWS at most: unpacked, they take several times their bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def count_words(texts: DataFrame) -> DataFrame:
    """(w, c) of all words of the one column."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["w", "c"])

        for batch in sliced(rows):
            for text in as_bytes(batch, 0):
                counts.update(map(name_of, tokens(text)))
                if len(counts) > PART:
                    yield out()
                    counts.clear()
        yield out()

    return texts.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def bucket_sums(counts: DataFrame, own: set[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket: the count of its words in training, and how many there are. counts: (w, c); own: words that are in none."""
    given = counts.sparkSession.sparkContext.broadcast(own)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in rows:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w not in given.value:
                    sums[:, bucket(w, buckets)] += (c, 1)
        at = np.nonzero(sums[1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["b", "c", "n"])

    found = counts.select("w", "c").mapInArrow(run, "b long, c long, n long").groupBy("b").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, buckets))
    out[:, found.column(0).to_numpy()] = found.column(1).to_numpy(), found.column(2).to_numpy()
    return out[0], out[1]


class Model:
    """Start, transition and emission probabilities; classes: words by rank, then the groups of other words, then the end."""

    def __init__(self, unigrams: np.ndarray, states: int = STATES, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.prior = (unigrams + 1) / (unigrams + 1).sum()
        self.start = np.full(states, 1 / states)
        self.move = (STICK * np.eye(states) + (1 - STICK) / states) * rng.uniform(0.9, 1.1, (states, states))
        self.move /= self.move.sum(axis=1, keepdims=True)
        self.emit = self.prior * np.exp(rng.normal(0, 0.5, (states, len(unigrams))))
        self.emit /= self.emit.sum(axis=1, keepdims=True)

    def update(self, sums: np.ndarray) -> None:
        """From the summed counts of expected()."""
        s, k = self.emit.shape
        self.start = (sums[k] + 1) / (sums[k] + 1).sum()
        self.move = sums[k + 1 : k + 1 + s] + 1
        self.move /= self.move.sum(axis=1, keepdims=True)
        self.emit = sums[:k].T + PRIOR * self.prior
        self.emit /= self.emit.sum(axis=1, keepdims=True)


def side_by_side(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences from the longest, and how many of them reach each step."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes[order[0]]) if len(sizes) else 0
    return order, np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")


def spans(active: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of steps with about so many tokens."""
    out, a, size = [], 0, 0
    for t, n in enumerate(active.tolist()):
        if size and size + n > most:
            out.append((a, t))
            a, size = t, 0
        size += n
    return [*out, (a, len(active))]


def in_steps(flat: np.ndarray, offset: np.ndarray, active: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the steps a..b-1, sequence beside sequence, and the places where steps begin (the end is the last)."""
    cuts = np.concatenate([[0], np.cumsum(active[a:b])])
    step = np.repeat(np.arange(b - a), active[a:b])
    return flat[offset[np.arange(len(step)) - cuts[step]] + step + a], cuts


_held: list[np.ndarray] = []


def workspace(rows: int, columns: int, kind: type = np.float64) -> list[np.ndarray]:
    """Two arrays of so many rows at least, kept by the worker, as new ones cost more than what is done in them."""
    if not _held or _held[0].shape[0] < rows or _held[0].shape[1] != columns or _held[0].dtype != kind:
        _held[:] = [np.empty((rows, columns), kind) for _ in range(2)]
    return _held


def expected(model: Model, flat: np.ndarray, sizes: np.ndarray, most: int = GROUP, kind: type = np.float64) -> np.ndarray:
    """Baum-Welch counts of whole sequences, a column for each state: a row for each class (emissions), one for the starts, one
    for each state (moves from it), and a last one whose first number is the log likelihood. kind: of the numbers at a token,
    which are scaled to a sum of one; what is added up over tokens is double."""
    s, k = model.emit.shape
    order, active = side_by_side(sizes)
    offset = (np.cumsum(sizes) - sizes)[order]
    table, move, turned = (np.ascontiguousarray(x, kind) for x in (model.emit.T, model.move, model.move.T))
    sums, moves = np.zeros((k + s + 2, s)), np.zeros((s, s))
    parts = spans(active, most)
    alphas, emitted = workspace(max(int(active[a:b].sum()) for a, b in parts), s, kind)  # of a span's tokens, step by step
    ones = np.ones((s, 1), kind)

    def forward(now: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From the sums before step a: the span's classes, the places where its steps begin, one by its scales, and the sums behind it."""
        seen, cuts = in_steps(flat, offset, active, a, b)
        np.take(table, seen, axis=0, out=emitted[: len(seen)], mode="clip")
        scale = np.empty((len(seen), 1), kind)
        bounds = cuts.tolist()
        for t in range(a, b):
            low, high = bounds[t - a], bounds[t - a + 1]
            own = alphas[low:high]
            if t:
                np.matmul(now[: high - low], move, out=own)
            else:
                own[:] = now[: high - low]
            own *= emitted[low:high]
            np.matmul(own, ones, out=scale[low:high])
            own /= scale[low:high]
            now = own
        return seen, cuts, scale, now

    entries = [np.tile(model.start.astype(kind), (len(sizes), 1))]
    for a, b in parts[:-1]:
        entries.append(forward(entries[-1], a, b)[-1].copy())
    back = np.ones((0, s), kind)
    for (a, b), entry in zip(reversed(parts), reversed(entries)):
        seen, cuts, scale, _ = forward(entry, a, b)
        into = emitted[: len(seen)]
        into /= scale
        bounds = cuts.tolist()
        for t in range(b - 1, a - 1, -1):
            low, high = bounds[t - a], bounds[t - a + 1]
            if len(back) < high - low:  # sequences that end here
                back = np.concatenate([back, np.ones((high - low - len(back), s), kind)])
            own = into[low:high]
            own *= back
            alphas[low:high] *= back
            if t:
                before = alphas[bounds[t - a - 1] :][: high - low] if t > a else entry[: high - low]
                moves += before.T @ own
                back = own @ turned
            else:
                sums[k] = alphas[:high].sum(axis=0, dtype=float)
        for i in range(s):
            sums[:k, i] += np.bincount(seen, weights=alphas[: len(seen), i], minlength=k)
        sums[-1, 0] += np.log(scale, dtype=float).sum()
    sums[k + 1 : k + 1 + s] = moves * model.move
    return sums


def log_likelihood(model: Model, flat: np.ndarray, sizes: np.ndarray, most: int = GROUP) -> np.ndarray:
    """Natural log probability of each whole sequence, by the scaled forward recursion."""
    order, active = side_by_side(sizes)
    offset = (np.cumsum(sizes) - sizes)[order]
    emit, total, ones = np.ascontiguousarray(model.emit.T), np.zeros(len(sizes)), np.ones((len(model.start), 1))
    now = np.tile(model.start, (len(sizes), 1))
    for a, b in spans(active, most):
        seen, cuts = in_steps(flat, offset, active, a, b)
        emitted = workspace(len(seen), len(model.start))[0]
        np.take(emit, seen, axis=0, out=emitted[: len(seen)], mode="clip")
        for t, low, high in zip(range(a, b), cuts.tolist(), cuts[1:].tolist()):
            now = now[: high - low] @ model.move if t else now[: high - low]
            now *= emitted[low:high]
            scale = now @ ones
            now /= scale
            total[: high - low] += np.log(scale[:, 0])
    out = np.empty(len(sizes))
    out[order] = total
    return out


def unpack(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(v) // 2 for v in values), np.int64, len(values))
    return np.frombuffer(b"".join(values), "<u2").astype(np.int64), sizes


def encode(docs: DataFrame, hot: list[tuple[bytes, int]], ends: int, classes: int, log_z: np.ndarray) -> DataFrame:
    """A row for each of docs (doc_id, held_out, text): see the plan's second step. log_z: of each bucket, log10 of its Z."""
    given = docs.sparkSession.sparkContext.broadcast((hot, ends, classes, log_z))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, ends, classes, log_z = given.value
        used, buckets = min(classes, len(hot)), len(log_z)
        number = {w: i for i, (w, _) in enumerate(hot)}
        logs = np.log10(np.array([c for _, c in hot], dtype=float) + 1)
        # Of each hot word: its class.
        of = np.array([i if i < used else used + bucket(w, buckets) for i, (w, _) in enumerate(hot)], np.int64)
        key = TaskContext.get().partitionId() << 36
        for batch in sliced(rows):
            texts, out = as_bytes(batch, 2), []
            start = 0
            while start < len(texts):  # parts of some MB
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or b"") < 4_000_000):
                    size += len(texts[stop] or b"")
                    stop += 1
                for text in texts[start:stop]:
                    ws = tokens(text)
                    ids = np.fromiter((number.get(w, -1) for w in ws), np.int64, len(ws))
                    far = np.nonzero(ids < 0)[0]
                    names = [name_of(ws[i]) for i in far.tolist()]
                    again = np.fromiter((number.get(w, -1) for w in names), np.int64, len(names))  # long words have other names
                    ids[far] = again
                    rare = [w for w, i in zip(names, again.tolist()) if i < 0]
                    known = ids >= 0
                    own = np.zeros(len(ws))
                    own[known] = logs[ids[known]]
                    kinds = np.empty(len(ws) + 1, np.int64)
                    kinds[:-1][known] = of[ids[known]]
                    kinds[:-1][~known] = [used + bucket(w, buckets) for w in rare]
                    kinds[-1] = used + buckets
                    other = kinds[:-1] >= used
                    other_sum = own[other].sum() - log_z[kinds[:-1][other] - used].sum()
                    out.append((len(ws) + 1, len(ws) - len(rare) + (ends > 0), own.sum() + np.log10(ends + 1), other_sum, kinds.astype("<u2").tobytes(), rare))
                part = batch.slice(start, stop - start)
                columns = list(zip(*out))
                keys = np.arange(key, key + len(out))
                key += len(out)
                out.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())))]],
                    ["key", "doc_id", "held_out", "n_tokens", "n_known", "log_sum", "other_sum", "obs", "rare"],
                )
                start = stop

    schema = f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_sum double, other_sum double, obs binary, rare array<binary>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def train(sequences: DataFrame, model: Model, rounds: int | None = None, gain: float = GAIN, kind: type = np.float64) -> Model:
    """Baum-Welch over the column obs, until a round gains less than `gain` a token or, if given, there were so many rounds. A task's
    counts are as large as the model however few rows it has, so there are TASKS for each core, not one for each split of the input."""
    spark = sequences.sparkSession
    sequences = sequences.select("obs").coalesce(TASKS * spark.sparkContext.defaultParallelism)
    shape = (sum(model.emit.shape) + 2, len(model.start))
    tokens = sequences.agg(F.sum(F.octet_length("obs") / 2)).first()[0]
    last = -np.inf
    for _ in (range(rounds) if rounds is not None else count()) if tokens else ():
        given = spark.sparkContext.broadcast(model)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for values in buffers(rows):
                for g in groups(sorted(values, key=len), GROUP, SIDE):
                    sums += expected(given.value, *g, GROUP, kind)
            yield counts_batch(sums)

        def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for batch in rows:
                np.add.at(sums, batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, shape[1]))
            yield counts_batch(sums)

        schema = "i long, v binary"
        found = sequences.mapInArrow(run, schema).repartition("i").mapInArrow(add, schema).toArrow()
        given.destroy()  # executors would hold the models of all rounds
        sums = np.zeros(shape)
        sums[found.column(0).to_numpy()] = np.frombuffer(b"".join(found.column(1).to_pylist())).reshape(-1, shape[1])
        model.update(sums)
        now = sums[-1, 0] / LOG10 / tokens
        if now - last < gain:
            break
        last = now
    return model


def counts_batch(sums: np.ndarray) -> pa.RecordBatch:
    """(i, v): the rows of the counts that aren't zero."""
    at = np.nonzero(sums.any(axis=1))[0]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([v.tobytes() for v in sums[at]], pa.binary())], ["i", "v"])


def buffers(rows: Iterator[pa.RecordBatch], most: int = BUFFER) -> Iterator[list[bytes]]:
    """The values of the first column in lists of about so many tokens."""
    held: list[bytes] = []
    size = 0
    for batch in sliced(rows):
        for v in batch.column(0).to_pylist():
            held.append(v)
            size += len(v) // 2
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def groups(values: list[bytes], most: int = BATCH, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences in runs of about so many tokens, of so many sequences at least."""
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) // 2 > most and i - start >= least:
            yield unpack(values[start:i])
            start, size = i, 0
        size += len(v) // 2
    if start < len(values):
        yield unpack(values[start:])


def score(docs: DataFrame, states: int = STATES, rounds: int | None = None, classes: int = CLASSES, hot_words: int = HOT, buckets: int = BUCKETS) -> tuple[DataFrame, Model]:
    """docs: doc_id, held_out, text. Returns a row each (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), and the model."""
    spark = docs.sparkSession
    training = docs.filter(~F.col("held_out"))
    counts = save(count_words(training.select("text")), "lm-counts")
    ends = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    rows = counts.orderBy(F.desc("c"), "w").limit(hot_words).toArrow()
    hot = list(zip(rows.column("w").to_pylist(), rows.column("c").to_pylist()))
    used = min(classes, len(hot))
    other, kinds = bucket_sums(counts, {w for w, _ in hot[:used]}, buckets)
    encoded = save(encode(docs, hot, ends, classes, np.log10(other + kinds + 1)), "lm-encoded")
    model = Model(np.array([*[c for _, c in hot[:used]], *other, ends], dtype=float), states)
    own = encoded.filter(~F.col("held_out"))
    for part in (own.filter(F.pmod(F.xxhash64("key"), F.lit(SHARE)) == 0), own):
        train(part, model, rounds, kind=np.float32)
    given = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [log_likelihood(given.value, *g) for g in groups(batch.column(1).to_pylist())]
            if done:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(done) / LOG10)], ["key", "hmm"])

    fields = "struct<key:bigint,n_tokens:bigint,n_known:bigint,log_sum:double,other_sum:double,held_out:boolean,doc_id:" + docs.schema["doc_id"].dataType.simpleString() + ">"
    own = encoded.select(F.struct("key", "n_tokens", "n_known", "log_sum", "other_sum", "held_out", "doc_id").alias("key"), "obs")
    forward = own.mapInArrow(run, f"key {fields}, hmm double").select("key.*", "hmm")
    rare = encoded.select(F.col("key").alias("rare_key"), F.explode("rare").alias("w"))
    met = rare.join(counts, "w").groupBy("rare_key").agg(F.count("*").alias("rare_n"), F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"))
    joined = forward.join(met, F.col("key") == F.col("rare_key"), "left")
    rare_n, rare_sum = F.coalesce("rare_n", F.lit(0)), F.coalesce("rare_sum", F.lit(0.0))
    result = joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + rare_n).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") + rare_sum - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("hmm") + F.col("other_sum") + rare_sum).alias("score"),
    )
    return result, model


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model learned from those whose remainder by 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 7) == 2
    return score(docs.select("doc_id", held.alias("held_out"), "text"))[0]
