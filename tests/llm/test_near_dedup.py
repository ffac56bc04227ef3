"""Near-duplicate removal by chosen paths against comparisons of all pairs."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import common, jaccard_join, near_dedup
from sparkloom.llm.oracles import near_dedup as near_dedup_sql

from brute import brute_classes
from test_corpus import near_copies, star


def brute(texts, gram=4, threshold=0.8):
    classes = brute_classes(texts, gram, threshold)
    size = lambda ws: len({tuple(ws[k : k + gram]) for k in range(max(1, len(ws) - gram + 1))}) if ws else 0
    return {i: (size((t or "").encode().lower().split()), classes[i][0], classes[i][0] == i) for i, t in texts.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


SMALL = {"BLOCK": 7, "SHARE": 1, "SMALL": 5}


@pytest.mark.parametrize("settings", [{}, SMALL, SMALL | {"BROADCAST_ROWS": 0}, SMALL | {"LEVELS": (1, 2)}])
def test_components(spark, texts, monkeypatch, settings):
    """Nodes that branch again, by pivots and blocks, by broadcast and by salts."""
    for name, value in settings.items():
        monkeypatch.setattr(common if name == "BROADCAST_ROWS" else near_dedup, name, value)
    rng = np.random.default_rng(3)
    given = near_copies(texts)
    for base in (20_000, 30_000):
        words = [f"w{base}x{i}" for i in range(120 if base == 20_000 else 60)]
        given |= {base + k: t for k, t in enumerate(star(60, words, rng))}
    rows = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    assert got(near_dedup.deduplicate(rows)) == brute(given)


@pytest.mark.parametrize("limit", ["BROADCAST_ROWS", "BROADCAST_BYTES"])
def test_driver_gathers_nothing_beyond_the_limit(spark, texts, monkeypatch, limit):
    """Sides that grow with the input are dealt by shuffles, however small Spark takes them to be."""
    for name, value in SMALL.items():
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(common, limit, -1)  # not even an empty side
    given = near_copies(texts)
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    known = max((e.executionId() for e in executions(store)), default=-1)
    assert got(near_dedup.deduplicate(spark.createDataFrame(list(given.items()), "doc_id long, text string"))) == brute(given)
    bus.waitUntilEmpty(30_000)
    plans = [e.physicalPlanDescription() for e in executions(store) if e.executionId() > known]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [line for p in plans for line in p.splitlines() if "Broadcast" in line]


def executions(store):
    found = store.executionsList()
    return [found.apply(i) for i in range(found.size())]


def test_other_grams_and_threshold(spark):
    given = dict(enumerate(star(50, [f"w{i}" for i in range(30)], np.random.default_rng(9)))) | {100 + k: f"a{k % 4} b c{k % 3} d e" for k in range(12)}
    rows = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    assert got(near_dedup.deduplicate(rows, 0.5, 2)) == brute(given, 2, 0.5)


def test_edge_cases(spark, docs, empty):
    rows = near_dedup.deduplicate(docs).collect()
    assert len(rows) == docs.count()
    found = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert found[(1, 1, True)] == 2 and found[(2, 1, False)] == 1 and found[(None, None, True)] == 1
    assert {r["doc_id"]: r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 5, 8)} == {3: 0, 4: 0, 5: 0, 8: 1}
    assert near_dedup.deduplicate(empty).count() == 0


def test_paths_depend_on_own_tokens_only():
    """Equal tokens give equal paths, wherever a text stands, and a path's places differ from each other."""
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 1 << 32, (4, near_dedup.PLACES), dtype=np.uint32)
    roots = near_dedup.mix(np.arange(1, 9, dtype=np.uint64))
    each = lambda rows: near_dedup.grow(np.tile(roots, len(rows)), np.repeat(np.arange(len(rows)), 8), tokens[rows], 4, 0.3)
    paths, owner, origin = each([0, 1, 2, 3])
    again, other, _ = each([3, 0])
    assert set(paths[owner == 3]) == set(again[other == 0]) and set(paths[owner == 0]) == set(again[other == 1])
    assert len(set(paths)) == len(paths) and not set(paths[owner == 1]) & set(paths[owner == 2])
    assert 0.8 < len(paths) / (32 * (1 / 0.3) ** 4) < 1.2 and (np.diff(origin) >= 0).all()


@pytest.mark.parametrize("agree", [0.7, 0.8, 0.9])
def test_survival_and_recall(agree):
    """Pairs with this share of equal tokens meet as often as is computed, and those at the threshold nearly always."""
    rng = np.random.default_rng(int(agree * 10))
    pairs = 1500
    tokens = rng.integers(0, 1 << 32, (2 * pairs, near_dedup.PLACES), dtype=np.uint32)
    same = rng.random((pairs, near_dedup.PLACES)) < agree
    tokens[1::2][same] = tokens[::2][same]
    trees = near_dedup.trees_for()
    roots = near_dedup.mix(np.arange(1, trees + 1, dtype=np.uint64))
    paths, owner, origin = near_dedup.grow(np.tile(roots, 2 * pairs), np.repeat(np.arange(2 * pairs), trees), tokens, near_dedup.LEVELS[-1], 0.8)
    nodes = defaultdict(set)
    for p, o in zip(paths.tolist(), owner.tolist()):
        nodes[p].add(o)
    tree = dict(zip(paths.tolist(), (origin % trees).tolist()))
    met = Counter({(min(m) // 2, tree[p]) for p, m in nodes.items() if len(m) > 1})
    share = sum(met.values()) / (pairs * trees)
    # The shares of equal tokens vary from pair to pair.
    assert abs(share - near_dedup.survival(agree, 0.8, near_dedup.LEVELS[-1])) < 0.03
    if agree >= 0.8:
        assert len({p for p, _ in met}) >= pairs - 3


def test_meet_equals_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, (9, 4)).astype(np.uint64)
    bits = seeds[rng.integers(0, 9, 80)] ^ (np.uint64(1) << rng.integers(0, 64, (80, 4)).astype(np.uint64))
    joined = rng.random(80) < 0.2
    found = []
    for small in (0, 1000):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        sets = jaccard_join.Sets(80)
        sets.name[joined] = np.nonzero(joined)[0][0]
        for i, j in near_dedup.meet(bits, 30, joined):
            assert sets.name[i] != sets.name[j]
            sets.join(i, np.array([j]))
        found.append(sets.name.tolist())
    assert found[0] == found[1] and len(set(found[0])) > 1


def test_against_sql(spark):
    """The same components by SQL over the next larger tables."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({near_dedup_sql()})").fetchall()}
    assert got(near_dedup.op12_minhash_near_dedup(spark, folder)) == want
