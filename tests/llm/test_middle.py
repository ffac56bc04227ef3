"""Fill-in-the-middle against regular expressions and plain cutting."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparkloom.llm import fill_in_middle as fim

F = fim.F
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, marks=("<P>", "<S>", "<M>"), seed=42):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n, (p, s, m) = len(units), marks
    if not text or any(x in text for x in marks) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"{s}{suffix}{p}{prefix}{m}{middle}") if h4 % 100 < 80 else ("psm", f"{p}{prefix}{s}{suffix}{m}{middle}")
    return n, form, len(prefix), len(middle), out


def cut(texts, **more):
    numbers = np.array([fim.draws(42, i) for i in range(len(texts))], np.int64)
    return [(*r[:4], r[4].decode()) for r in fim.cut([t.encode() for t in texts], numbers, **more)]


@pytest.mark.parametrize("lane", [1, 3, 64])
def test_random_texts(monkeypatch, lane):
    monkeypatch.setattr(fim.Scan.__init__, "__defaults__", (lane,))
    rng = random.Random(lane)
    parts = ["a", "P", "S", "M", "<", ">", " ", "\n", "\t", "é", "中", "🙂", "\x1f", "\x85", " ", "<P>", "<S", "<<M>", "  "]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(20)]
        assert cut(texts) == [brute(i, t) for i, t in enumerate(texts)]


def test_other_sentinels():
    marks = ("⟦vor⟧", "|nach>", "~-")
    texts = [f"ein Wort{x} und noch {y} Wörter " for x in ("", "⟦vor⟧", "⟦vor", "~", "~~-", "|nach>", "|na") for y in ("", "⟦", "⟧~", "\x9f")]
    assert cut(texts, marks=fim.Sentinels(*marks)) == [brute(i, t, marks) for i, t in enumerate(texts)]
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "|S|", "<M>"), ("<P>", "P>", "<M>"), ("ab", "bc", "x"), ("a b", "c", "d"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.Sentinels(*bad)


def test_entries_depend_on_what_came_before():
    """Lanes within one long word, one sentinel's letters, one character."""
    texts = ["P" * 5000, "<" * 3000 + "P>", "🙂" * 2000, " " * 4000, "<P" * 2000, "é" * 3001 + " "]
    assert cut(texts) == [brute(i, t) for i, t in enumerate(texts)]


def test_bytes_that_are_no_text():
    raw = b"a \xff\xfe b\x80\x80 \xe4\xb8 c \xf0\x9f\x99"
    for i in range(40):
        n, form, prefix, middle, out = fim.cut([raw], np.array([fim.draws(42, i)], np.int64))[0]
        assert n == 6 and (form != "plain" or out == raw)
        if form == "spm":
            suffix, rest = out.removeprefix(b"<S>").split(b"<P>")
            assert b"".join(rest.split(b"<M>")) + suffix == raw


@pytest.mark.parametrize("which", ["docs", "corpus", "empty"])
def test_rows(request, which):
    rows = request.getfixturevalue(which)
    made = fim.transform(rows)
    out = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str((r["doc_id"], *brute(r["doc_id"], r["text"]), r["text"] or "")) for r in rows.collect()))
    assert sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"])) for r in out) == want


def test_very_long_text(spark):
    text = "wort é中 " * 400_000
    rows = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    out = fim.transform(rows).withColumn("same", fim.restored(F.col("output"), F.col("form")) == text).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "same").collect()
    assert {(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) for r in out} == {(i, *brute(i, text)[:4]) for i in range(6)}
    assert all(r["same"] for r in out) and {r["form"] for r in out} > {"plain"}
