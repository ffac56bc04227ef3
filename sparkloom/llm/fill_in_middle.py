"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries and put together again around sentinels.

A unit is a word with the white space before it, or the white space at a text's end (ASCII white space). Where the two cuts fall,
and what form the output has, follows from a hash of the seed and the document's id, so it is the same wherever it is computed.

Method. `Automaton` is a table: its states are what has been read of a unit, of a UTF-8 sequence and of a sentinel, its input
classes of bytes. Each transition emits whether a unit ended before the byte, a code point began, a sentinel was completed, or a
text ended. A batch of texts, each closed by a byte that UTF-8 doesn't have, is one run of bytes, cut into lanes of LANE bytes:

1. The scan. All lanes step through the table side by side from every state, so that each lane's exits for its entries are known;
   the entries then follow from lane to lane. The lanes step once more from these, and what their transitions emit is kept and
   counted by lane.
2. The cuts. A cut is so many ends of units behind the text's begin: the lane that has it is found in the running counts, its
   place in what that lane emitted; so are the code points before it.

A text's length doesn't matter for this, as a lane is as long in any text. There is no shuffle.

Defined results: a null text is the empty text, whose form is plain. A null id is hashed as an empty one. Repeated rows give equal
rows. Bytes that are no UTF-8 are cut like others; each that stands where no code point can is one. A text that contains a
sentinel is plain, whatever its hash. A very long text is held whole, in some bytes for each of its own. An empty table gives an
empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
PLAIN_FROM = 50  # of 100: the share of texts with a middle
SPM_BELOW = 80  # of 100: the share of those with the suffix first
LANE = 256
BATCH_BYTES = 4_000_000
SPACE = b" \t\n\v\f\r"
END = 0xFF  # stands behind each text; no byte of UTF-8

# What a transition emits.
UNIT, POINT, SENTINEL, TEXT = 1, 2, 4, 8


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = [m.encode() for m in self.marks]
        inside = any(a in b for a in marks for b in marks if a is not b)
        overlap = any(a[-n:] == b[:n] for a in marks for b in marks for n in range(1, min(len(a), len(b))))
        if not all(marks) or len(set(marks)) < 3 or inside or overlap or any(set(m) & set(SPACE) for m in marks):
            raise ValueError("sentinels have to be three different words, of which none begins like one ends")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Automaton:
    """kind: the class of each byte; move and emit: by state * classes + class. State 0 is a text's begin."""

    def __init__(self, marks: tuple[bytes, ...]) -> None:
        own = sorted(set(b"".join(marks)))
        names = ["end", "space", "other", "continuation", "lead2", "lead3", "lead4", *own]
        self.kind = np.full(256, names.index("other"), np.uint8)
        for name, low, high in (("continuation", 0x80, 0xC0), ("lead2", 0xC2, 0xE0), ("lead3", 0xE0, 0xF0), ("lead4", 0xF0, 0xF5)):
            self.kind[low:high] = names.index(name)
        self.kind[list(SPACE)] = names.index("space")
        self.kind[END] = names.index("end")
        for b in own:
            self.kind[b] = names.index(b)
        leads = {"lead2": 1, "lead3": 2, "lead4": 3} | {b: 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 for b in own if 0xC2 <= b < 0xF5}
        begun = {m[:n] for m in marks for n in range(len(m) + 1)}

        def after(state: tuple[str, int, bytes], name: str | int) -> tuple[tuple[str, int, bytes], int]:
            unit, pending, read = state
            if name == "end":
                return ("begin", 0, b""), TEXT | (UNIT if unit != "begin" else 0)
            if name == "space":
                return ("space", 0, b""), POINT | (UNIT if unit == "word" else 0)
            inside = pending > 0 and (name == "continuation" or isinstance(name, int) and 0x80 <= name < 0xC0)
            now = read + bytes([name]) if isinstance(name, int) else b""
            done = SENTINEL if now.endswith(marks) else 0
            while now not in begun:
                now = now[1:]
            return ("word", pending - 1 if inside else leads.get(name, 0), now), done | (0 if inside else POINT)

        queue = [("begin", 0, b"")]
        states, made = {queue[0]: 0}, []
        for state in queue:  # which grows meanwhile
            for name in names:
                target, out = after(state, name)
                if target not in states:
                    states[target] = len(states)
                    queue.append(target)
                made.append((states[target], out))
        self.states, self.classes = len(states), len(names)
        self.move, self.emit = (np.array(x, np.uint8) for x in zip(*made))


@cache
def automaton(marks: tuple[str, ...]) -> Automaton:
    return Automaton(tuple(m.encode() for m in marks))


class Scan:
    """What the transitions over texts, each closed by END, emitted: by byte and counted by lane."""

    def __init__(self, data: np.ndarray, table: Automaton, lane: int = LANE) -> None:
        self.lane, count = lane, max(1, -(-len(data) // lane))
        kinds = np.zeros((count, lane), np.uint8)  # what is behind the last text is ends of empty ones
        kinds.reshape(-1)[: len(data)] = table.kind[data]
        steps = np.ascontiguousarray(kinds.T).astype(np.intp)
        state = self.entries(steps, table)
        flags = np.empty((lane, count), np.uint8)
        for out, step in zip(flags, steps):
            at = state * table.classes + step
            np.take(table.emit, at, out=out)
            state = table.move[at].astype(np.intp)
        self.flags = np.ascontiguousarray(flags.T)
        self.counts = {what: np.append(0, np.cumsum(np.count_nonzero(self.flags & what, axis=1))) for what in (UNIT, POINT, SENTINEL)}

    @staticmethod
    def entries(steps: np.ndarray, table: Automaton) -> np.ndarray:
        """The state in which each lane begins."""
        count = steps.shape[1]
        exits = np.repeat(np.arange(table.states)[None], count, axis=0)
        for k, step in enumerate(steps):
            exits = table.move[exits * table.classes + step[:, None]].astype(np.intp)
            if (exits == exits[:, :1]).all():  # no lane's exit depends on its entry any more
                state = exits[:, 0]
                for later in steps[k + 1 :]:
                    state = table.move[state * table.classes + later].astype(np.intp)
                return np.append(0, state[:-1])
        found, now = [], 0
        for of in exits.tolist():
            found.append(now)
            now = of[now]
        return np.array(found, np.intp)

    def before(self, what: int, places: np.ndarray) -> np.ndarray:
        """How many transitions emitted this before each place."""
        lanes, rest = np.divmod(places, self.lane)
        inner = np.minimum(lanes, len(self.flags) - 1)
        upto = np.arange(self.lane) < rest[:, None]
        return self.counts[what][lanes] + np.count_nonzero((self.flags[inner] & what).astype(bool) & upto, axis=1)

    def place(self, what: int, number: np.ndarray) -> np.ndarray:
        """Where the transition stands that emitted this for the so-manieth time, from one."""
        counts = self.counts[what]
        lanes = np.searchsorted(counts, number, side="left") - 1
        running = np.cumsum((self.flags[lanes] & what).astype(bool), axis=1)
        return lanes * self.lane + np.argmax(running >= (number - counts[lanes])[:, None], axis=1)


def draws(seed: int, doc_id: object) -> tuple[int, ...]:
    """Four numbers of 32 bits for a document."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut(texts: list[bytes], numbers: np.ndarray, marks: Sentinels = Sentinels(), plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> list[tuple]:
    """(n, form, code points of the prefix, of the middle, output) of each text; numbers: four of each (`draws`)."""
    closed = b"".join(x for t in texts for x in (t.replace(b"\xff", b"\xfe"), b"\xff"))
    scan = Scan(np.frombuffer(closed, np.uint8), automaton(marks.marks))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    begins = np.append(0, ends[:-1])
    first, last = scan.before(UNIT, begins), scan.before(UNIT, ends)
    n = last - first
    held = scan.before(SENTINEL, ends) > scan.before(SENTINEL, begins)
    plain = (ends - begins == 1) | held | (numbers[:, 2] % 100 >= plain_from)
    chosen = np.sort(numbers[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(begins[:, None], 2, axis=1)
    some = chosen > 0
    at[some] = scan.place(UNIT, (first[:, None] + chosen)[some])
    points = [scan.before(POINT, p) for p in (begins, at[:, 0], at[:, 1])]
    low, high = (at - begins[:, None]).T.tolist()
    spm = numbers[:, 3] % 100 < spm_below
    p, s, m = (x.encode() for x in marks.marks)
    out = []
    for i, t in enumerate(texts):
        if plain[i]:
            out.append((int(n[i]), "plain", None, None, t))
            continue
        prefix, middle, suffix = t[: low[i]], t[low[i] : high[i]], t[high[i] :]
        form, whole = ("spm", s + suffix + p + prefix + m + middle) if spm[i] else ("psm", p + prefix + s + suffix + m + middle)
        out.append((int(n[i]), form, int(points[1][i] - points[0][i]), int(points[2][i] - points[1][i]), whole))
    return out


def transform(docs: DataFrame, seed: int = SEED, marks: Sentinels = Sentinels(), plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs (doc_id, text): n units; form plain, psm or spm; output: the text for training."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            start = size = 0
            for stop in range(1, len(texts) + 1):
                size += len(texts[stop - 1])
                if size < BATCH_BYTES and stop < len(texts):
                    continue
                own = ids.slice(start, stop - start)
                numbers = np.array([draws(seed, i) for i in own.to_pylist()], np.int64)
                columns = zip(*cut(texts[start:stop], numbers, marks, plain_from, spm_below))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                start, size = stop, 0

    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output of this form was made of. No sentinel is in the parts, so each is found where it was put."""

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, third, 1)
        return one, two, F.substring(rest, F.length(two) + len(third) + 1, F.length(rest))

    prefix, suffix, middle = parts(marks.prefix, marks.suffix, marks.middle)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(marks.suffix, marks.prefix, marks.middle)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and digests of its output and of the text rebuilt from that."""
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
