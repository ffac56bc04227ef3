"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one DuckDB per Python worker.

Encoding. A text is cut by the vocabulary's pattern. A piece that is itself in the vocabulary is one token. Every other
distinct piece becomes token-position rows (piece, position, token, next token); a recursive query joins them with the merge
table, takes each piece's lowest-ranked pair (the leftmost one of equals), contracts it, and goes on until no pair is left.

Pieces of over LONG bytes (blobs, scripts without spaces) are contracted as overlapping windows by the same query, side by side.
A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs: no contraction ever
goes over a boundary that two neighbours keep, so what happens on either side doesn't matter. So where two windows that overlap
have a token in common, with the same place and length, the tokens of the first up to it and of the second from it are the
encoding of both. Where two have none, their stretch is cut anew into windows of twice the size, up to the whole piece.

Decoding. Rows (text, position, token) join the vocabulary; an ordered aggregation concatenates their bytes.

The ranks go to executors as a broadcast of the file's bytes (a fixed size). Encoded pieces are kept in a worker's cache of at
most CACHE entries and CACHE_BYTES bytes. Batches are cut by size, a query takes pieces up to SQUARES, so memory does not
depend on a partition's size; texts are never cut.

Defined results: null text is the empty text, with no tokens. Repeated rows are encoded one by one, ids (null too) are passed
through, and other columns, whatever their names, are not looked at. An empty table gives an empty result. A very long text is
encoded whole, in time that grows with its length. There is no shuffle and no key.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LONG = 48
WINDOW = 32  # bytes of the first windows of a long piece
CACHE = 300_000
CACHE_BYTES = 64_000_000  # of ids that are kept for long pieces
SQUARES = 8_000_000  # of a query's pieces, the sum of their squared lengths: about twice the rows that it holds
BATCH_CHARS = 4_000_000

#: k: rank << 20 | position of the pair that starts at the row, null without one. The row at the pair's start goes, the one after it takes the merged token.
CONTRACT_SQL = """
WITH RECURSIVE s(w, pos, a, b, k, it) AS (
  SELECT w, pos, a, b, m.r | pos, 0 FROM init LEFT JOIN merges m ON m.ab = (init.a << 20 | init.b)
  UNION ALL
  SELECT x.w, x.pos, x.a, x.b, m.r | x.pos, x.it FROM (
    SELECT s.w, s.pos - (s.pos > t.p)::INT AS pos, CASE WHEN s.pos = t.p + 1 THEN t.m ELSE s.a END AS a,
           CASE WHEN s.pos = t.p - 1 THEN t.m ELSE s.b END AS b, s.it + 1 AS it
    FROM s JOIN (SELECT w, min(k) & 1048575 AS p, min(k) >> 20 AS m FROM s GROUP BY w HAVING min(k) IS NOT NULL) t ON s.w = t.w
    WHERE s.pos <> t.p) x LEFT JOIN merges m ON m.ab = (x.a << 20 | x.b)
)
SELECT s.w, s.a FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) z ON s.w = z.w AND s.it = z.it ORDER BY s.w, s.pos
"""

DECODE_SQL = "SELECT d, array_to_string(list(s ORDER BY p), '') AS t FROM tokens JOIN vocabulary USING (id) GROUP BY d"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Of a rank file: lines of a token in base 64 and its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}


def windows(begin: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Windows of so many bytes, each from the middle of the one before."""
    while True:
        yield begin, min(begin + size, end)
        if begin + size >= end:
            return
        begin += size // 2


class Codec:
    """An encoder and decoder for one vocabulary; holds a DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, data: bytes, pattern: str) -> None:
        import duckdb
        import numpy as np
        import regex

        self.ranks = ranks = read_ranks(data)
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self.cache: dict[str, bytes] = {}
        self.cached_bytes = 0  # of long pieces' ids
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        pairs = [(ranks[t[:i]] << 20 | ranks[t[i:]], r << 20) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        given = pa.table({"ab": [p[0] for p in pairs], "r": [p[1] for p in pairs]})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE merges AS SELECT ab::BIGINT AS ab, r::BIGINT AS r FROM given")
        self.db.unregister("given")
        # Bytes travel as the characters U+0100 to U+01FF, so that the low half of UTF-16 is the bytes.
        given = pa.table({"id": list(ranks.values()), "s": ["".join(chr(256 + b) for b in t) for t in ranks]})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE vocabulary AS SELECT id::INT AS id, s FROM given")
        self.db.unregister("given")

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit little-endian bytes, by recursive queries."""
        out: list[bytes] = []
        start = squares = 0
        for i, p in enumerate(pieces):
            if squares and squares + len(p) ** 2 > SQUARES:
                out += self.contract_once(pieces[start:i])
                start, squares = i, 0
            squares += len(p) ** 2
        return out + self.contract_once(pieces[start:]) if start < len(pieces) else out

    def contract_once(self, pieces: list[bytes]) -> list[bytes]:
        import numpy as np

        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        tokens = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        following = np.append(tokens[1:], -1)
        following[ends - 1] = -1
        w = np.repeat(np.arange(len(pieces)), lengths)
        init = pa.table({"w": w, "pos": np.arange(len(tokens)) - np.repeat(ends - lengths, lengths), "a": tokens, "b": following})
        self.db.register("init", init)
        out = self.db.execute(CONTRACT_SQL).fetchnumpy()
        self.db.unregister("init")
        ids = np.asarray(out["a"]).astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(np.asarray(out["w"]), minlength=len(pieces)))]) * 4
        cuts = cuts.tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def contract_long(self, pieces: list[bytes], window: int = WINDOW) -> list[bytes]:
        """The same, by windows: see above."""
        import numpy as np

        known: dict[tuple[int, int, int], tuple] = {}  # (piece, begin, end): (starts, ids) of the window's tokens
        todo = [(w, a, b, window) for w, p in enumerate(pieces) for a, b in windows(0, len(p), window)]
        while True:
            new = list({x[:3] for x in todo} - known.keys())
            found = self.contract([pieces[w][a:b] for w, a, b in new])
            for (w, a, b), raw in zip(new, found):
                ids = np.frombuffer(raw, "<u4")
                sizes = self.lengths[ids]
                known[w, a, b] = (np.cumsum(sizes) - sizes + a, ids)
            # The first token in common of each window and the next one, not before that of the window before.
            meet: list[int] = []
            failed = []
            for i, (w, a, b, _) in enumerate(todo):
                if i + 1 == len(todo) or todo[i + 1][0] != w:
                    meet.append(-1)
                    continue
                (x, p), (y, q) = known[w, a, b], known[todo[i + 1][:3]]
                least = max(todo[i + 1][1], meet[-1] if meet else -1)
                k = int(np.searchsorted(x, least))
                both, j, m = np.intersect1d(x[k:], y, assume_unique=True, return_indices=True)
                same = np.nonzero(p[k:][j] == q[m])[0]
                meet.append(int(both[same[0]]) if len(same) else -2)
                if not len(same):
                    failed.append(i)
            if not failed:
                break
            again: list[tuple[int, int, int, int]] = []
            i, wrong = 0, set(failed)
            while i < len(todo):
                if i not in wrong:
                    again.append(todo[i])
                    i += 1
                    continue
                stop = i
                while stop in wrong:
                    stop += 1
                w, size = todo[i][0], 2 * max(x[3] for x in todo[i : stop + 1])
                again += [(w, a, b, size) for a, b in windows(todo[i][1], todo[stop][2], size)]
                i = stop + 1
            kept = {x[:3] for x in again}
            known = {k: v for k, v in known.items() if k in kept}
            todo = again
        parts: list[list[bytes]] = [[] for _ in pieces]
        since = 0
        for (w, a, b, _), until in zip(todo, meet):
            x, ids = known[w, a, b]
            low, high = np.searchsorted(x, since), len(x) if until < 0 else np.searchsorted(x, until)
            parts[w].append(ids[low:high].tobytes())
            since = max(until, 0)
        return [b"".join(p) for p in parts]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that the cache lacks."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE or self.cached_bytes > CACHE_BYTES:
            self.cache.clear()
            self.cached_bytes = 0
            new = list(pieces)
        short: list[tuple[str, bytes]] = []
        long: list[tuple[str, bytes]] = []
        for p in new:
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[p] = rank.to_bytes(4, "little")
            else:
                (long if len(raw) > LONG else short).append((p, raw))
        self.cache.update(zip((p for p, _ in short), self.contract([raw for _, raw in short])))
        made = self.contract_long([raw for _, raw in long])
        self.cache.update(zip((p for p, _ in long), made))
        self.cached_bytes += sum(map(len, made))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian bytes."""
        cut = [self.find(t) for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in cut]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        import numpy as np

        sizes = np.fromiter((len(x) // 4 for x in encoded), np.int64, len(encoded))
        tokens = pa.table({"d": np.repeat(np.arange(len(encoded)), sizes), "p": np.arange(sizes.sum()), "id": np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)})
        self.db.register("tokens", tokens)
        out = self.db.execute(DECODE_SQL).fetchall()
        self.db.unregister("tokens")
        texts = [b""] * len(encoded)
        for d, t in out:
            texts[d] = t.encode("utf-16-le")[::2]
        return texts


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary, made once."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def batches(rows: Iterator[pa.RecordBatch], most: int = BATCH_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """(first column, texts of the second) in runs of about so many characters, one row at least."""
    for batch in rows:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.column(0).slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.column(0).slice(start), texts[start:]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """(key, ids: binary of 32-bit little-endian ids, decoded: binary) of each row; path: a rank file that the driver reads."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for keys, texts in batches(rows):
            c = c or codec(data.value, pattern)
            ids = c.encode(texts)
            back = c.decode(ids) if decoded else [None] * len(ids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"key {kind}, ids binary, decoded binary")
    return out.withColumnRenamed("key", key)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded from its ids."""
    import public_tokenizers
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
