"""Language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary: all of its ordinary pieces, folded to lower case as the words are. Each language has a
probability per piece; a word's probability is the sum, over all ways to cut it into pieces, of the product of their
probabilities (a forward algorithm over its characters), and a text's is the product over its words. The probabilities are
trained by expectation-maximisation: backward sums give each piece's expected count.

Training takes a bounded sample: at most PER_LANGUAGE labelled documents of each language, those of the lowest hash of their
id, of the LANGUAGES most frequent labels. Languages are trained side by side, one group each, whose size that bound limits.
The model (pieces times languages) is the only thing that reaches the driver, and is broadcast. Prediction is narrow: no
shuffle, no key, batches cut by size.

Words are maximal runs of characters other than white space, in lower case, of any length: in scripts without spaces a whole
sentence is one. Those of LONG characters or more are summed in logarithms, side by side, in training and prediction alike. A
character outside the vocabulary costs every language the same.

Defined results: a text that is null or has no letter is `und`, with score 0; so is every text if nothing can be learned from.
Ties go to the first language in order. The score is the posterior probability of the predicted language. Rows with a null
language or text teach nothing; a null id counts as not held out. Repeated rows are predicted one by one. An empty table gives
an empty result. A very long text or word is scored whole, in memory of some bytes a character. Columns other than text are
never looked at by a prediction; `filter_stage` passes all of them through, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .byte_bpe import batches
from .common import remainder

PER_LANGUAGE = 400
LANGUAGES = 200
OVERSAMPLE = 3
ROUNDS = 4
LONG = 32
FLOOR = 1e-7  # of a character outside the vocabulary
SMOOTH = 0.05  # expected counts added to each piece
WORDS = 12_000  # distinct words in a lattice
PLACES = 200_000  # characters of long words summed side by side
BATCH_CHARS = 4_000_000


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, folded to lower case; a leading mark stands for a word's begin."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in found if p})


class Pieces:
    """A trie over the pieces, as arrays: children of state s by character class c at s * classes + c."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.unknown = len(pieces)
        self.most = max(map(len, pieces))  # characters of a piece
        chars = sorted({c for p in pieces for c in p})
        self.classes = len(chars) + 1
        self.codes = np.array([ord(c) for c in chars], dtype=np.uint32)
        place = {c: i + 1 for i, c in enumerate(chars)}
        nodes: dict[tuple[int, int], int] = {}
        terminal = {0: -1}
        for n, p in enumerate(pieces):
            state = 0
            for c in p:
                state = nodes.setdefault((state, place[c]), len(nodes) + 1)
                terminal.setdefault(state, -1)
            terminal[state] = n
        self.terminal = np.array([terminal[i] for i in range(len(nodes) + 1)], dtype=np.int32)
        keys = np.array([s * self.classes + c for s, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(nodes.values()), dtype=np.int32)[order]
        self.root = np.zeros(self.classes, dtype=np.int32)
        for (s, c), n in nodes.items():
            if s == 0:
                self.root[c] = n

    def classify(self, text: str) -> np.ndarray:
        """Each character's class; 0: in no piece."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.codes, raw), len(self.codes) - 1)
        return np.where(self.codes[at] == raw, at + 1, 0)

    def arcs(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in the words; left: characters from each to its word's end."""
        states = self.root[chars]
        alone = np.where(states > 0, self.terminal[states], -1)
        starts = [np.arange(len(chars))]
        lengths = [np.ones(len(chars), dtype=np.int64)]
        found = [np.where(alone >= 0, alone, self.unknown)]
        at = np.nonzero((states > 0) & (left > 1))[0]
        states = states[at]
        for n in range(2, self.most + 1):
            keys = states.astype(np.int64) * self.classes + chars[at + n - 1]
            where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[where] == keys
            at, states = at[hit], self.next[where[hit]]
            ends = self.terminal[states]
            if (ok := ends >= 0).any():
                starts.append(at[ok])
                lengths.append(np.full(int(ok.sum()), n))
                found.append(ends[ok])
            more = left[at] > n
            at, states = at[more], states[more]
            if not len(at):
                break
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)


class Lattice:
    """All segmentations of some words under LONG characters, for forward and backward sums over columns (languages)."""

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        marked = ["▁" + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        chars = pieces.classify("".join(marked))
        word = np.repeat(np.arange(len(marked)), sizes)
        start, length, self.piece = pieces.arcs(chars, ends[word] - np.arange(len(chars)))
        # Slots: each word has one more than its characters.
        self.source = start + word[start]
        self.target = self.source + length
        self.word = word[start]
        self.first = ends - sizes + np.arange(len(marked))
        self.last = ends + np.arange(len(marked))
        self.slots = len(chars) + len(marked)
        key = (self.target - self.first[self.word]) * (pieces.most + 1) + length
        order = np.argsort(key.astype(np.int16), kind="stable")
        self.source, self.target, self.piece, self.word, key = self.source[order], self.target[order], self.piece[order], self.word[order], key[order]
        cuts = np.nonzero(np.diff(key))[0] + 1
        self.runs = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)])) if len(key) else []

    def forward(self, probs: np.ndarray) -> np.ndarray:
        sums = np.zeros((self.slots, probs.shape[1]))
        sums[self.first] = 1
        for a, b in self.runs:  # each run has one arc at most into a slot
            sums[self.target[a:b]] += sums[self.source[a:b]] * probs[self.piece[a:b]]
        return sums

    def score(self, probs: np.ndarray) -> np.ndarray:
        """Log probability of each word in each column."""
        return np.log(self.forward(probs)[self.last])

    def expected(self, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece, for one column; weight: of each word."""
        sums, back = self.forward(probs), np.zeros((self.slots, 1))
        back[self.last] = 1
        for a, b in reversed(self.runs):
            np.add.at(back[:, 0], self.source[a:b], (back[self.target[a:b]] * probs[self.piece[a:b]])[:, 0])
        share = sums[self.source, 0] * probs[self.piece, 0] * back[self.target, 0] / sums[self.last, 0][self.word] * weight[self.word]
        return np.bincount(self.piece, weights=share, minlength=len(probs))


class LongWords:
    """All segmentations of some words of any length, for forward and backward sums in logarithms, word beside word.

    `probs` has a row for each piece and one for the unknown character, as for Lattice. Places are taken in runs, for which the
    pieces that end at each are looked up again, so that memory is a few numbers a character.
    """

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        self.pieces, self.none = pieces, pieces.unknown + 1
        self.order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), dtype=np.int64)
        self.chars = [pieces.classify("▁" + words[i]) for i in self.order]
        self.sizes = np.fromiter(map(len, self.chars), np.int64, len(words))
        self.longest = int(self.sizes[0])
        step = max(pieces.most, PLACES // len(words))
        self.spans = [(a, min(a + step, self.longest)) for a in range(0, self.longest, step)]

    def ending(self, a: int, b: int) -> np.ndarray:
        """Piece by (place - a, characters - 1, word) for those that end at a place in a..b-1 (its last character); none: self.none."""
        most, live = self.pieces.most, int((self.sizes > a).sum())
        out = np.full((b - a, most, len(self.sizes)), self.none, np.int32)
        low = max(0, a - most + 1)
        parts = [c[low:b] for c in self.chars[:live]]
        sizes = np.fromiter(map(len, parts), np.int64, live)
        ends, word = np.cumsum(sizes), np.repeat(np.arange(live), sizes)
        start, length, piece = self.pieces.arcs(np.concatenate(parts), ends[word] - np.arange(len(word)))
        own = word[start]
        last = start - (ends - sizes)[own] + low + length - 1
        new = last >= a
        out[last[new] - a, length[new] - 1, own[new]] = piece[new]
        return out

    def forward(self, probs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(a, b, sums): log sums, by (place, word, column), of the places a-most..b; those of place i are over all cuts of the first i characters."""
        most, table = self.pieces.most, np.vstack([probs, np.zeros((1, probs.shape[1]))])
        sums = np.full((most, len(self.sizes), probs.shape[1]), -np.inf)
        sums = np.concatenate([sums, np.zeros((1, *sums.shape[1:]))])
        for a, b in self.spans:
            found = self.ending(a, b)
            sums = np.concatenate([sums[-most - 1 :], np.full((b - a, *sums.shape[1:]), -np.inf)])
            live = np.searchsorted(-self.sizes, -np.arange(a, b), side="left")  # words with a character there
            for i, n in enumerate(live.tolist()):
                past = sums[i + 1 : i + most + 1, :n][::-1]
                now = (np.exp(past - past[0]) * table[found[i, :, :n]]).sum(axis=0)
                sums[i + most + 1, :n] = past[0] + np.log(now)
            yield a, b, sums

    def score(self, probs: np.ndarray) -> np.ndarray:
        """Log probability of each word in each column."""
        out = np.empty((len(self.sizes), probs.shape[1]))
        for a, b, sums in self.forward(probs):
            done = np.nonzero((self.sizes > a) & (self.sizes <= b))[0]
            out[self.order[done]] = sums[self.sizes[done] - a + self.pieces.most, done]
        return out

    def expected(self, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece, for one column; weight: of each word."""
        most, every = self.pieces.most, np.arange(len(self.sizes))
        ahead = np.full((most + self.longest + 1, len(every)), -np.inf)
        for a, b, sums in self.forward(probs):
            ahead[a : b + most + 1] = sums[:, :, 0]
        whole = ahead[self.sizes + most, every]
        with np.errstate(divide="ignore"):
            logs = np.log(np.append(probs[:, 0], 0))
        back, total = np.full_like(ahead, -np.inf), np.zeros(len(probs) + 1)
        back[self.sizes + most, every] = 0
        weight = weight[self.order]
        for a, b in reversed(self.spans):
            found = self.ending(a, b)
            share = np.empty(found.shape)
            for i in range(b - a - 1, -1, -1):
                at = a + i + 1  # behind the last character
                into = logs[found[i]] + back[at + most]
                window = slice(at, at + most)
                share[i] = ahead[window][::-1] + into
                back[window] = np.logaddexp(back[window], into[::-1])
            total += np.bincount(found.ravel(), weights=(np.exp(share - whole) * weight).ravel(), minlength=len(total))
        return total[:-1]


def long_groups(words: list[str], which: list[int]) -> Iterator[list[int]]:
    """The given places of words in groups that are summed side by side, like lengths together."""
    group: list[int] = []
    for i in sorted(which, key=lambda i: len(words[i])):
        if group and (len(group) + 1) * (len(words[i]) + 1) > PLACES:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def split_words(text: str) -> list[str]:
    return text.lower().split()


def train_language(pieces: Pieces, texts: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (the unknown character last) by expectation-maximisation over the words of the texts."""
    counts: Counter[str] = Counter()
    for t in texts:
        counts.update(split_words(t))
    n = len(pieces.pieces)
    probs = np.full((n + 1, 1), 1 / n)
    probs[n] = FLOOR
    every = list(counts)
    weight = np.array([counts[w] for w in every], dtype=float)
    short = [i for i, w in enumerate(every) if len(w) < LONG]
    parts = [(Lattice, short[i : i + WORDS]) for i in range(0, len(short), WORDS)]
    parts += [(LongWords, g) for g in long_groups(every, [i for i, w in enumerate(every) if len(w) >= LONG])]
    for _ in range(rounds):
        total = np.zeros(n + 1)
        for kind, own in parts:
            total += kind(pieces, [every[i] for i in own]).expected(probs, weight[own])
        known = total[:n] + SMOOTH
        probs[:n, 0] = known / known.sum()
    return probs[:, 0]


def train(docs: DataFrame, pieces: list[str], per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities with a column each, from rows of doc_id, text and lang."""
    spark = docs.sparkSession
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("h"))
    # A first cut by hash to some OVERSAMPLE times the bound, so that what reaches a language's task doesn't grow with the input.
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, OVERSAMPLE * per_language / n)]), F.col("lang")) if sizes else F.lit(1.0)
    known = known.filter(F.pmod("h", F.lit(1 << 40)) < share * float(1 << 40))
    ranked = known.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.length("text"), "text")))
    sample = ranked.filter(F.col("n") <= per_language).select("lang", "text")
    given = spark.sparkContext.broadcast(pieces)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        probs = train_language(Pieces(given.value), part["text"].tolist())
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "probs": [probs.tolist()]})

    rows = sample.groupBy("lang").applyInPandas(fit, "lang string, probs array<double>").collect()  # a row a language
    rows = sorted(rows, key=lambda r: r["lang"])
    probs = np.array([r["probs"] for r in rows]).T if rows else np.zeros((len(pieces) + 1, 0))
    return [r["lang"] for r in rows], probs


class Scorer:
    """Predicts for batches of texts."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray) -> None:
        self.languages, self.pieces, self.probs = np.array([*languages, "und"], dtype=object), Pieces(pieces), probs

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.probs.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        for i in range(0, len(short), WORDS):
            part = short[i : i + WORDS]
            out[part] = Lattice(self.pieces, [words[k] for k in part]).score(self.probs)
        for group in long_groups(words, [i for i, w in enumerate(words) if len(w) >= LONG]):
            out[group] = LongWords(self.pieces, [words[i] for i in group]).score(self.probs)
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores."""
        blank = np.array([not any(map(str.isalpha, t)) for t in texts])
        if not self.probs.shape[1]:
            return np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        number: defaultdict[str, int] = defaultdict(count().__next__)
        ids = [np.fromiter(map(number.__getitem__, split_words(t)), np.int64) for t in texts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = np.zeros((len(texts), self.probs.shape[1]))
        if number:
            scores = self.word_scores(list(number))
            some = np.nonzero(sizes)[0]
            starts = (np.cumsum(sizes) - sizes)[some]
            flat = np.concatenate(ids)
            for k in range(scores.shape[1]):
                total[some, k] = np.add.reduceat(scores[flat, k], starts)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        best[blank], share[blank] = len(self.languages) - 1, 0
        return self.languages[best], share


def predict(docs: DataFrame, languages: list[str], pieces: list[str], probs: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each row; a key that is a struct holds the text, which then isn't sent to Python twice."""
    inside = isinstance(docs.schema[key].dataType, StructType)
    given = docs.sparkSession.sparkContext.broadcast((languages, pieces, probs))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if inside:
            rows = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(text)], ["key", "text"]) for b in rows)
        for keys, texts in batches(rows, BATCH_CHARS):
            scorer = scorer or Scorer(*given.value)
            names, scores = scorer.predict(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(names.tolist(), pa.string()), pa.array(scores)], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(*([key] if inside else [key, text])).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identify(docs: DataFrame, training: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of docs, learned from the labelled rows of training."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    pieces = load_pieces(vocabulary)
    languages, probs = train(training, pieces)
    return predict(docs, languages, pieces, probs, key)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose remainder by 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    out = identify(docs.select("doc_id", "text"), docs.filter(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


LEAST_SCORE = 0.5


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognisable language (`und`, or a score under LEAST_SCORE) go."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = identify(own, docs.select("doc_id", "text", "lang"), key="row")
    kept = out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
