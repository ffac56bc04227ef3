"""Spelling variants against plain edit distances."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import spelling_variants as sv

F = sv.F
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_counts(rows, typos=97, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % typos else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_counts(docs, corpus, empty):
    for rows in (docs, corpus, empty):
        want = brute_counts([(r["doc_id"], r["text"]) for r in rows.collect()])
        assert {r["word"]: r["n"] for r in sv.count_words(rows).collect()} == dict(want)
        assert {r["word"]: r["n"] for r in sv.count_words(rows, typos=2, least=1).collect()} == dict(brute_counts([(r["doc_id"], r["text"]) for r in rows.collect()], 2, 1))


def test_corpus(spark, corpus):
    counts = {w: n for w, n in brute_counts([(r["doc_id"], r["text"]) for r in corpus.collect()]).items() if n >= 3}
    assert rows_of(sv.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == brute(counts)


@pytest.mark.parametrize("letters, lengths", [("ab", (1, 7)), ("abc", (3, 6)), ("aé×", (1, 5))])
def test_dense_words(spark, letters, lengths):
    """Few letters, so that runs of equal letters, ties and large groups are common."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(150)}
    counts = {w: rng.choice([3, 5, 5, 8, 13, 40, 200]) for w in words}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(sv.group_variants(rows)) == brute(counts)


def test_long_words_and_chains(spark):
    base = "ab" * 20_000
    words = {base: 100, base[:-1] + "c": 3, base[1:]: 3, "a" * 50_000: 7, "a" * 49_999: 60, "a" * 25_000 + "b" + "a" * 24_999: 2}
    words |= {"x" * 5 + chr(97 + i) * 3: 3 << i for i in range(4)} | {"k" * (6 + i): 3 << i for i in range(16)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(sv.group_variants(rows)) == brute(words)


def test_keys_are_hashes_of_deletions():
    """A deletion's key is that of the word that equals it."""
    words = ["abbba", "bbba", "abba", "é", "aaaa", "aaa", "zéz"]
    owner, key, place, length = sv.deletion_keys(words)
    own = {words[o]: k for o, k, p in zip(owner, key, place) if p < 0}
    found = {(words[o], words[o][:p] + words[o][p + 1 :], n): k for o, k, p, n in zip(owner, key, place, length) if p >= 0}
    assert found[("abbba", "bbba", 1)] == own["bbba"] and found[("abbba", "abba", 3)] == own["abba"] and found[("aaaa", "aaa", 4)] == own["aaa"]
    assert len(found) == 3 + 2 + 3 + 1 + 1 + 1 + 3 and len({*own.values()}) == len(words)


def test_collisions_are_told_apart(spark, monkeypatch):
    """With keys of two bits, only strings tell words apart."""
    real = sv.deletion_keys
    monkeypatch.setattr(sv, "deletion_keys", lambda words: (lambda o, k, p, n: (o, k & np.uint64(3 << 62), p, n))(*real(words)))
    rng = random.Random(4)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))): rng.randint(3, 99) for _ in range(60)}
    keys = sv.keyed(sv.numbered(spark.createDataFrame(list(counts.items()), "word string, n long").coalesce(1)))
    assert keys.select("id").distinct().count() == len(counts)
    groups = [(i, w, n, p, m) for i, (w, n) in enumerate(counts.items()) for o, k, p, m in zip(*sv.deletion_keys([w]))]
    near, best = Counter(), {}
    for i, n, c, w in sv.linked(groups):
        near[i] += n
        best[i] = min(best.get(i, (1, "")), (-c, w))
    want = {w: (n_near, form) for w, form, _, _, n_near, _ in brute(counts)}
    for i, (w, n) in enumerate(counts.items()):
        found = best.get(i, (0, None))
        assert (near[i], found[1] if -found[0] >= 2 * n else None) == want[w]


def test_edge_cases(spark, docs, empty):
    assert sv.group_variants(sv.count_words(empty)).collect() == []
    counts = {w: n for w, n in brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if n >= 1}
    assert rows_of(sv.group_variants(sv.count_words(docs))) == brute(counts)
