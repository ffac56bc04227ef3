"""Operators over the whole corpus, against brute force."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest

from sparkloom.llm import best_fit_packing, common, jaccard_join, language_id, lm_scoring

from brute import brute_classes, brute_training, cuts, log_sums

F = lm_scoring.F


@pytest.mark.parametrize("which", ["docs", "corpus"])
def test_packing(spark, request, which):
    rows = request.getfixturevalue(which)
    capacity = 300
    out = best_fit_packing.pack(rows, capacity, 60).collect()
    given = rows.collect()
    assert sum(r["length"] for r in out) == sum(len((r["text"] or "").encode().split()) for r in given)
    source = {r["doc_id"]: r["source"] for r in given}
    bins = defaultdict(list)
    for r in out:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r["slot"])
        assert [m["bin_start"] for m in members] == [sum(x["length"] for x in members[:i]) for i in range(len(members))]
        assert sum(m["length"] for m in members) <= capacity
        known = [source[m["doc_id"]] for m in members if source[m["doc_id"]] is not None]
        assert len(known) == len(set(known))


def test_packing_spreads_repeated_rows(spark, empty):
    """20,000 times the same row: groups stay of bounded size, and no two of them share a bin."""
    rows = spark.range(20_000).selectExpr("1L AS doc_id", "'a b c' AS text", "CAST(NULL AS STRING) AS source").union(spark.sql("SELECT 2L, 'x y', 's'"))
    out = best_fit_packing.pack(rows).selectExpr("bin_id", "bin_id >> 24 AS g", "doc_id").collect()
    sizes = Counter(r["g"] for r in out)
    assert len(out) == 20_001 and max(sizes.values()) <= 2 * best_fit_packing.GROUP and len(sizes) > 3
    assert len({r["bin_id"] for r in out if r["doc_id"] == 1}) == 20_000
    assert best_fit_packing.pack(empty).count() == 0


def test_best_fit_is_tightest():
    rng = np.random.default_rng(5)
    items = [(int(n), int(s), int(c)) for n, s, c in zip(rng.integers(1, 100, 300), rng.integers(0, 6, 300), rng.integers(0, 60, 300))]
    bins = []
    for (n, s, c), got in zip(items, best_fit_packing.best_fit(items, 100)):
        fits = [(100 - sum(x[0] for x in b), i) for i, b in enumerate(bins) if 100 - sum(x[0] for x in b) >= n and all(x[1] != s and x[2] != c for x in b)]
        want = min(fits)[1] if fits else len(bins)
        assert got == want
        if want == len(bins):
            bins.append([])
        bins[want].append((n, s, c))


def test_lm(spark, corpus, texts, docs, empty):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    rows = corpus.select("doc_id", (lm_scoring.remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    out, model = lm_scoring.score(rows, states=3, rounds=2, classes=50, hot_words=200, buckets=7)
    counts = Counter()
    for i, t in texts.items():
        if not held[i]:
            counts.update(t.encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    ranked = sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], w))[:50]
    number = {w: i for i, w in enumerate(ranked)}
    z = [sum(c + 1 for w, c in counts.items() if w is not None and w not in number and lm_scoring.bucket(w, 7) == b) + 1 for b in range(7)]
    class_of = lambda w: 57 if w is None else number.get(w, 50 + lm_scoring.bucket(w, 7))
    for r in out.collect():
        ws = [*texts[r["doc_id"]].encode().lower().split(), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        a, total = model.start, 0.0
        for k, w in enumerate(ws):
            a = (a @ model.move if k else a) * model.emit[:, class_of(w)]
            total += math.log10(a.sum()) + (0 if w is None or w in number else math.log10((counts[w] + 1) / z[class_of(w) - 50]))
            a = a / a.sum()
        assert r["score"] == pytest.approx(total)
    for given in (docs, empty):
        rows = given.select("doc_id", F.lit(True).alias("held_out"), "text")
        assert lm_scoring.score(rows)[0].count() == given.count()


def test_lm_of_long_words(spark):
    """Frequent and rare words of any length have an emission and a count: by a name of bounded size."""
    long, other = "x" * 5000, "y" * 300
    rows = spark.createDataFrame([(i, i % 4 == 0, f"a b {long} c {other if i == 7 else 'd'}") for i in range(40)], "doc_id long, held_out boolean, text string")
    out = {r["doc_id"]: r for r in lm_scoring.score(rows, states=2, classes=3, hot_words=4, buckets=2)[0].collect()}
    assert all(r["n_tokens"] == 6 and r["n_known"] == 6 and math.isfinite(r["score"]) for r in out.values()) and out[7]["score"] < out[9]["score"]
    assert len(lm_scoring.name_of(long.encode())) == 17 and lm_scoring.name_of(b"z" * 64) == b"z" * 64
    total = 10 ** out[4]["score"]
    assert 0 < total < 1


def brute_counts(model, sequences):
    """Expected counts of all paths of states written out."""
    s, k = model.emit.shape
    sums = np.zeros((k + s + 2, s))
    for seq in sequences:
        paths = list(product(range(s), repeat=len(seq)))
        each = np.array([model.start[p[0]] * np.prod([model.emit[i, w] for i, w in zip(p, seq)]) * np.prod([model.move[i, j] for i, j in zip(p, p[1:])]) for p in paths])
        sums[-1, 0] += math.log(each.sum())
        for p, share in zip(paths, each / each.sum()):
            sums[k, p[0]] += share
            for i, w in zip(p, seq):
                sums[w, i] += share
            for i, j in zip(p, p[1:]):
                sums[k + 1 + i, j] += share
    return sums


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_baum_welch_counts(most):
    """Against all paths, whether a sequence's sums are held whole or computed again in spans."""
    rng = np.random.default_rng(4)
    model = lm_scoring.Model(rng.integers(1, 9, 5).astype(float), 3)
    sequences = [rng.integers(0, 5, n) for n in (1, 6, 3, 6, 2, 5)]
    got = lm_scoring.expected(model, np.concatenate(sequences), np.array(list(map(len, sequences))), most)
    assert np.allclose(got, brute_counts(model, sequences))
    assert np.allclose(lm_scoring.log_likelihood(model, np.concatenate(sequences), np.array(list(map(len, sequences)))).sum(), got[-1, 0])


def test_single_precision_at_tokens():
    """Counts are added up in double, so that single precision at a token costs some digits of each only."""
    rng = np.random.default_rng(5)
    model = lm_scoring.Model(rng.integers(1, 99, 400).astype(float), 6)
    sequences = [rng.integers(0, 400, n) for n in rng.integers(1, 900, 60)]
    flat, sizes = np.concatenate(sequences), np.array(list(map(len, sequences)))
    one, two = (lm_scoring.expected(model, flat, sizes, 2000, kind) for kind in (np.float32, np.float64))
    assert np.abs(one - two)[:-1].max() < 1e-4 * two[:-1].max() and abs(one[-1, 0] - two[-1, 0]) < 1e-6 * len(flat)
    assert one[:400].sum() == pytest.approx(len(flat), rel=1e-6) and lm_scoring.workspace(5, 6, np.float64)[0].dtype == float


def test_training_begins_with_a_share(spark, monkeypatch):
    """The rounds over all sequences end by the same rule, whatever share came first, and score as well."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", (lm_scoring.remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    found = []
    for share in (1 << 62, 4):
        monkeypatch.setattr(lm_scoring, "SHARE", share)
        out = lm_scoring.score(rows, states=4, classes=500, buckets=50)[0].collect()
        found.append(sum(r["score"] for r in out) / sum(r["n_tokens"] for r in out))
    assert abs(found[0] - found[1]) < 0.05


def test_baum_welch_raises_likelihood():
    rng = np.random.default_rng(6)
    flat, sizes = rng.choice(8, 3000, p=np.arange(1, 9) / 36), np.array([700, 300, 1, 1999])
    flat[::3] = 1
    model, seen = lm_scoring.Model(np.bincount(flat, minlength=8).astype(float), 3), []
    for _ in range(8):
        sums = lm_scoring.expected(model, flat, sizes, 400)
        assert sums[:8].sum() == pytest.approx(3000) and sums[9:12].sum() == pytest.approx(2996)
        seen.append(sums[-1, 0])
        model.update(sums)
    assert lm_scoring.log_likelihood(model, flat, sizes).sum() > seen[-1] > seen[0]


def test_training_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP", 300)
    rng = np.random.default_rng(7)
    values = [(rng.integers(0, 30, n).astype("<u2").tobytes(),) for n in rng.integers(1, 90, 120)]
    start = np.bincount(np.frombuffer(b"".join(v for v, in values), "<u2"), minlength=30).astype(float)
    rows = spark.createDataFrame(values, "obs binary")
    one, many = (lm_scoring.train(rows.repartition(n), lm_scoring.Model(start, 4), 4, 0.0) for n in (1, 7))
    assert np.allclose(one.emit, many.emit, rtol=1e-9) and np.allclose(one.move, many.move, rtol=1e-9) and np.allclose(one.start, many.start, rtol=1e-9)
    assert lm_scoring.train(rows.limit(0), lm_scoring.Model(start, 4)).emit.shape == (4, 30)


def test_lm_beats_unigrams(spark):
    """On documents that it didn't see, by a margin, in all and for most of them."""
    out = lm_scoring.op4_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    n = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] - r["base_score"] for r in out) / n > 0.15
    assert sum(r["score"] > r["base_score"] for r in out) > 0.9 * len(out)


def test_language(spark, corpus, docs, empty):
    held = language_id.remainder(F.col("doc_id"), 4) == 2
    out = language_id.identify(corpus.select("doc_id", "text"), corpus.filter(~held))
    pairs = [(r["lang"], r["lang_pred"]) for r in out.join(corpus.filter(held), "doc_id").collect()]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs) > 0
    rows = language_id.identify(docs.select("doc_id", "text"), corpus).collect()
    assert Counter((r["lang_pred"], r["score"]) for r in rows)["und", 0.0] == 4
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), empty).collect()} == {"und"}
    assert language_id.filter_stage(spark, docs, "").columns == docs.columns
    assert language_id.filter_stage(spark, empty, "").count() == 0


@pytest.fixture(scope="module")
def trie():
    return language_id.Pieces(language_id.load_pieces(P.path("piece_bpe_32k.model")))


def test_pieces_are_whole(trie):
    """Every ordinary piece takes part, whatever its case and length."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    known = set(trie.pieces)
    assert all(m.id_to_piece(i).lower() in known for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))
    assert trie.most == max(map(len, known)) > 10


SOME = ["the", "station", "ération", "中文x", "a", "über🙂", "x" * 25]
LONGER = ["responsibilities" * 4, "中文字符没有空格的句子" * 9, "x" * 33, "ab" * 150, "🙂" * 40]


def test_segmentations(trie, monkeypatch):
    index = {p: i for i, p in enumerate(trie.pieces)}
    probs = np.random.default_rng(0).random((len(trie.pieces) + 1, 2)) * 1e-3
    probs[-1] = language_id.FLOOR
    brute = lambda words: [[log_sums(w, index, probs[:, k], trie.most)[-1] for k in range(2)] for w in words]
    assert np.allclose(language_id.Lattice(trie, SOME).score(probs), brute(SOME))
    assert np.allclose(language_id.LongWords(trie, SOME + LONGER).score(probs), brute(SOME + LONGER))
    monkeypatch.setattr(language_id, "PLACES", 100)  # runs of few places
    assert np.allclose(language_id.LongWords(trie, LONGER).score(probs), brute(LONGER))
    assert sorted(i for g in language_id.long_groups(LONGER, [0, 2, 3]) for i in g) == [0, 2, 3]


def test_expected_pieces(trie, monkeypatch):
    """Backward sums against all cuts written out, and long words against short ones' sums."""
    index = {p: i for i, p in enumerate(trie.pieces)}
    probs = np.random.default_rng(1).random((len(trie.pieces) + 1, 1)) * 1e-3
    few, weight = ["the", "station", "中文x", "über🙂", "banana"], np.array([1.0, 2, 3, 4, 5])
    want = np.zeros(len(probs))
    for w, c in zip(few, weight):
        every = cuts(w, index)
        each = np.array([np.prod(probs[list(x), 0]) for x in every])
        for x, p in zip(every, each / each.sum() * c):
            np.add.at(want, list(x), p)
    assert np.allclose(language_id.Lattice(trie, few).expected(probs, weight), want)
    assert np.allclose(language_id.LongWords(trie, few).expected(probs, weight), want)
    monkeypatch.setattr(language_id, "PLACES", 100)
    texts = [" ".join(SOME), " ".join(LONGER), " ".join(SOME[:3] + LONGER[:2])]
    got = language_id.train_language(trie, texts, 2)
    assert np.allclose(got, brute_training(texts, trie.pieces, 2, language_id.FLOOR, language_id.SMOOTH))


def test_language_without_spaces(spark):
    """Sentences without spaces are words of some length; they teach and are told apart."""
    rng = np.random.default_rng(2)
    parts = {"zh": "我们 今天 在 学校 学习 历史 地理 他们 明天 去 北京 看 朋友 这个 问题 很 重要 因为 经济 发展".split(), "ja": "私たち は 今日 学校 で 歴史 を 学びます 明日 東京 へ 行き この 問題 が とても 重要 です から 経済".split()}
    rows = [(k * 100 + i, "".join(rng.choice(parts[lang], 60)) + "。", lang) for k, lang in enumerate(parts) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(docs.filter("doc_id % 100 >= 20").select("doc_id", "text"), docs.filter("doc_id % 100 < 20")).collect()
    assert len(out) == 40 and all(r["lang_pred"] == ("zh" if r["doc_id"] < 100 else "ja") and r["score"] > 0.99 for r in out)


def test_language_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = spark.createDataFrame([(i, "some words", f"l{min(i, 7) // 3}") for i in range(10)], "doc_id long, text string, lang string")
    assert language_id.train(rows, ["▁some", "▁", "w", "o", "r", "d", "s"])[0] == ["l0", "l2"]


def near_copies(texts):
    """The corpus, and a chain of texts that each differ a little, more than a block of them."""
    words = " ".join(texts.values()).split()[:400]
    more = dict(texts)
    for k in range(40):
        own = list(words)
        for at in range(k % 7, k, 7):
            own[(at * 37) % 400] = f"new{at}"
        more[10_000 + k] = " ".join(own)
    return more


def star(n, base, rng, most=6):
    """Copies of a text in which a few words each are replaced, some by the same ones."""
    out = []
    for k in range(n):
        own = list(base)
        for at in rng.choice(len(base), rng.integers(0, most), replace=False):
            own[at] = f"other{rng.integers(0, 3)}" if rng.random() < 0.3 else f"own{k}"
        out.append(" ".join(own))
    return out


SMALL = {"VERIFY_BLOCK": 7, "FAR_BLOCK": 5, "BLOCK": 7, "SHARE": 1}


@pytest.mark.parametrize("settings", [{}, SMALL, SMALL | {"BROADCAST_ROWS": 0, "PIVOT_TEXTS": 3}, SMALL | {"PIVOT_TEXTS": 0}])
def test_jaccard(spark, texts, monkeypatch, settings):
    """Large groups with and without a pivot, near to it and far, by broadcast and by salts."""
    for name, value in settings.items():
        monkeypatch.setattr(common if name == "BROADCAST_ROWS" else jaccard_join, name, value)
    rng = np.random.default_rng(3)
    given = near_copies(texts)
    for base in (20_000, 30_000):
        words = [f"w{base}x{i}" for i in range(120 if base == 20_000 else 60)]
        given |= {base + k: t for k, t in enumerate(star(60, words, rng))}
    rows = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classify(rows).collect()}
    assert got == brute_classes(given)


def test_other_grams_and_threshold(spark, monkeypatch):
    """Pairs of words at a threshold of one half."""
    monkeypatch.setattr(jaccard_join, "VERIFY_BLOCK", 10)
    given = dict(enumerate(star(50, [f"w{i}" for i in range(30)], np.random.default_rng(9)))) | {100 + k: f"a{k % 4} b c{k % 3} d e" for k in range(12)}
    rows = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    out = jaccard_join.join_texts(rows.select(jaccard_join.row_key(rows).alias("id"), "text"), "id", 0.5, 2)
    assert {r["key"]["doc_id"]: (r["class_id"], r["links"]) for r in out.collect()} == brute_classes(given, 2, 0.5)


def test_near_group_is_not_copied(spark):
    """Texts that differ little from what most of their group have are in no block: what is dealt doesn't grow with the group."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, k, 1, 700, t) for k, t in enumerate(star(700, words, rng, 4))]
    members = spark.createDataFrame(rows, "root long, node long, copies long, texts long, text string")
    merges, links, _ = jaccard_join.verify(members, 0.8)
    assert links.count() == 700 and {r["links"] for r in links.collect()} == {699} and merges.count() == 699
    part = __import__("pandas").DataFrame({"root": 1, "budget": 100, "w": [0, 10, 40, 60, 95, 300], "copies": [1, 2, 3, 4, 5, 6], "n": [1, 1, 1, 1, 1, 1]})
    out = jaccard_join.within(part, 2)
    assert out["linked"].tolist() == [15, 10, 10, 6, 1, 0] and out["far"].tolist() == [False] * 3 + [True] * 3
    assert out["used"].all() and set(out["far_blocks"]) == {2} and set(out["near_blocks"]) == {2}
    assert not jaccard_join.within(part[:3], 2)["used"].any()


@pytest.mark.parametrize("depth", [1, 5, 6, 8])
def test_climb(depth):
    """The merges join what all pairs below the prefix would, with fewer comparisons, and equal labels are runs."""
    rng = np.random.default_rng(depth)
    labels = rng.integers(0, 3, (90, jaccard_join.DEPTH - depth)).astype(np.uint64) << np.uint64(30)
    tail = jaccard_join.tails(labels)
    order = np.argsort(tail, kind="stable")
    labels, tail = labels[order], tail[order]
    assert [tuple(x) for x in labels] == sorted(tuple(x) for x in labels)
    seeds = rng.integers(0, 1 << 63, (12, 4)).astype(np.uint64)
    bits = seeds[rng.integers(0, 12, 90)] ^ (np.uint64(1) << rng.integers(0, 64, (90, 4)).astype(np.uint64))
    got, want = jaccard_join.Sets(90), jaccard_join.Sets(90)
    merges = list(jaccard_join.climb(bits, tail.view(np.int64), 30, depth))
    for i, j in merges:
        assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= 30 and got.name[i] != got.name[j]
        got.join(i, np.array([j]))
    for i in range(90):
        near = np.nonzero(np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= 30)[0]
        want.join(i, near)
    assert (got.name == want.name).all() and len(set(want.name.tolist())) > 1


def test_prefix_depth():
    depth = jaccard_join.prefix_depth()
    reach = lambda d: 1 - (1 - jaccard_join.THRESHOLD**d) ** jaccard_join.TREES
    assert reach(depth) >= jaccard_join.RECALL > reach(depth + 1)
    assert jaccard_join.prefix_depth(0.99) == jaccard_join.DEPTH


def test_jaccard_edge_cases(spark, docs, empty):
    rows = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.classify(docs.select("doc_id", "text")).collect()), key=str)
    assert (1, 1, 2) in rows and (2, 1, 2) in rows and (3, 3, 0) in rows and (None, None, 0) in rows and len(rows) == docs.count()
    kept = jaccard_join.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, None, 7, 8, 9])
    assert jaccard_join.classify(empty.select("doc_id", "text")).count() == 0 and jaccard_join.keep_one(spark, empty, "").count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1040)]
    up = {x: x for p in pairs for x in p}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
