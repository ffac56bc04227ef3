"""Every stage of the pipeline, and the whole of it, against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from sparkloom.llm import best_fit_packing, language_id, quality_rules, secret_scans

from brute import base_counts, brute_classes, brute_training, log_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def line_ok(line):
    ws = WORD.findall(line)
    n, count = len(ws), lambda p: len(re.findall(p, line, re.A))
    if not n:
        return True
    separators = count(quality_rules.SEPARATORS)
    return (
        (n <= 3 or bool(re.search(quality_rules.SENTENCE_END, line, re.A)) or (n >= 20 and bool(re.search(quality_rules.SENTENCE_INSIDE, line))))
        and count(quality_rules.SYMBOLS) <= n * 0.3
        and count("!") <= n * 0.3
        and not (separators >= 3 and separators > n * 0.15)
        and not (n <= 25 and re.search(quality_rules.BOILERPLATE, line, re.A))
        and (n < 10 or len(set(ws)) >= n * 0.3)
    )


def quality(rows):
    out = []
    for r in rows:
        counts = base_counts(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if line_ok(x)]
        left = sum(len(w) for x in lines for w in WORD.findall(x))
        if not counts[-1] and left >= 0.5 * counts[1]:
            text = "\n".join(lines)
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def languages(rows):
    pieces = language_id.load_pieces(P.path("piece_bpe_32k.model"))
    index, most = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    taught = defaultdict(list)
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            taught[r["lang"]].append(r["text"])
    assert all(len(t) <= language_id.PER_LANGUAGE for t in taught.values())
    probs = [brute_training(taught[k], pieces, language_id.ROUNDS, language_id.FLOOR, language_id.SMOOTH) for k in sorted(taught)]
    known = {}

    def score(word):
        if word not in known:
            known[word] = np.array([log_sums(word, index, p, most)[-1] for p in probs])
        return known[word]

    out = []
    for r in rows:
        if any(map(str.isalpha, r["text"] or "")):
            total = sum(n * score(w) for w, n in Counter(r["text"].lower().split()).items())
            if 1 / np.exp(total - total.max()).sum() >= 0.5:
                out.append(r)
    return out


def one_each(rows):
    classes = brute_classes({r["doc_id"]: r["text"] for r in rows})
    return [r for r in rows if classes[r["doc_id"]][0] == r["doc_id"]]


def masked(rows):
    """A mask stands where a match begins that none goes over from before."""
    out = []
    for r in rows:
        text, made = r["text"] or "", []
        spans = [m.span() for rule in secret_scans.RULES for m in re.finditer(rule.pattern, text, re.A) if len(m.group(rule.group)) >= rule.least]
        hidden = {k for a, b in spans for k in range(a, b)}
        begins = {a for a, _ in spans if not any(x < a < y for x, y in spans)}
        for k, c in enumerate(text):
            if k in begins:
                made.append(secret_scans.MASK)
            if k not in hidden:
                made.append(c)
        text = "".join(made)
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def bins(rows, capacity=best_fit_packing.CAPACITY):
    """The members (doc_id, start, length) of every bin, and the documents without words."""
    items = [(len(WORD.findall(r["text"] or "")), r["doc_id"], r["source"], " ".join(WORD.findall(r["text"] or "")).lower()) for r in rows]
    made, whole = [], []
    for n, i, source, text in sorted(items, key=lambda x: (-(x[0] % capacity), x[1])):
        whole += [frozenset({(i, k * capacity, capacity)}) for k in range(n // capacity)]
        rest = n % capacity
        if rest:
            fits = [(b["left"], k) for k, b in enumerate(made) if b["left"] >= rest and source not in b["sources"] and text not in b["texts"]]
            at = min(fits)[1] if fits else len(made)
            if not fits:
                made.append({"left": capacity, "sources": set(), "texts": set(), "members": set()})
            b = made[at]
            b["left"] -= rest
            b["sources"].add(source)
            b["texts"].add(text)
            b["members"].add((i, n - rest, rest))
    return Counter(whole + [frozenset(b["members"]) for b in made]), sorted(i for n, i, _, _ in items if not n)


def packed(rows):
    found, blank = defaultdict(set), []
    for r in rows:
        if r["bin_id"] is None:
            blank.append(r["doc_id"])
        else:
            found[r["bin_id"]].add((r["doc_id"], r["doc_start"], r["length"]))
    return Counter(map(frozenset, found.values())), sorted(blank)


BRUTE = [quality, languages, one_each, masked]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """A folder whose documents are the fixture's and some with secrets, which the fixture of this size lacks."""
    rows = [tuple(r) for r in corpus.select(*COLUMNS).collect()]
    for k, r in enumerate([r for r in rows if len(r[1].split()) > 60 and "\n" not in r[1]][:6]):
        text = " ".join(r[1].split()[::-1]) + f' and token = "{k}abcdef{k}" or AKIA{k}BCDEFGHIJKLMNOP{k} with password:hunter{k}2 here.'
        rows.append((90_000 + k, text, r[2], f"planted{k}", len(text)))
    path = f"{tmp_path_factory.mktemp('planted')}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The rows before the first stage and after each."""
    out = [[r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]]
    for stage in BRUTE:
        out.append(stage(out[-1]))
    return out


@pytest.mark.parametrize("place", range(4))
def test_stage(spark, steps, folder, place):
    """Each on the rows that plain Python kept before it."""
    rows = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in steps[place]], SCHEMA)
    out = corpus_pipeline.STAGES[place][1](spark, rows, folder)
    assert out.columns == COLUMNS
    got = sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())
    assert got == sorted(tuple(r[c] for c in COLUMNS) for r in steps[place + 1])


def test_stages_decide(steps):
    sizes = list(map(len, steps))
    assert sizes[0] > sizes[1] > sizes[3] > 0 and steps[3] != steps[4]


def test_whole(spark, steps, folder):
    assert packed(corpus_pipeline.run(spark, folder).collect()) == bins(steps[-1])


def test_empty(spark, empty, tmp_path):
    """No documents: every stage and the whole give no rows, with their columns."""
    empty.select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}")
    assert out.count() == 0 and "bin_id" in out.columns


def test_clusters(spark):
    """Equal words are one cluster whatever the white space around them."""
    rows = spark.createDataFrame([(1, "a b", "x"), (2, "\n a\tB \n", "y"), (3, "c", "z")], "doc_id long, text string, source string")
    made, _ = packed(best_fit_packing.pack(rows).collect())
    assert sorted(map(len, made)) == [1, 2]
