"""Bucketed tables, recursion over data, vector search, samples, variants, and the Python source."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fixpoint, neighbours, samples
from sparkloom.plans import beyond
from sparkloom.plans.catalogue import QUERIES
from sparkloom.sources import segments
from sparkloom.sources.bucketed import bucketed
from sparkloom.streaming import sinks, state, windows

DATA = "/root/testdata/sf0.001"


def plan(rows, mode="formatted"):
    return rows.sparkSession._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", ["bucketed_join", "bucketed_without"])
def test_buckets_need_no_exchange(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text


def test_bucketed_rows(spark):
    """Nulls and a hot key; other numbers of buckets still join rightly."""
    rows = spark.range(500).selectExpr("IF(id % 3 = 0, 1, IF(id % 50 = 1, NULL, id)) AS k", "id AS v")
    one, two = bucketed(rows, "one", ["k"], 8), bucketed(rows.limit(0), "none", ["k"], 8)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert one.join(two, "k").count() == 0 and one.join(bucketed(rows, "three", ["k"], 3), "k").count() == rows.join(rows.withColumnRenamed("v", "w"), "k").count()


def test_deep_recursion(spark):
    """A chain longer than recursive CTEs go, in as many rounds, with its tables compacted on the way."""
    edges = spark.range(105).selectExpr("id AS src", "id + 1 AS dst").coalesce(1)
    found = {r["node"]: r["hops"] for r in fixpoint.reach(edges, spark.range(1).selectExpr("id AS node")).collect()}
    assert found == {i: i for i in range(106)}


def test_reach(spark):
    """Cycles, several seeds, seeds without edges, null ends, repeated edges, a bound on the rounds."""
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2))] * 2 + [(7, 7), (None, 3), (3, None)]
    edges, seeds = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(1,), (1,), (99,)], "node long")
    for rounds in (None, 2):
        want, new = {1: 0, 99: 0}, {1, 99}
        while new and (rounds is None or max(want.values()) < rounds):
            hops = max(want[n] for n in new) + 1
            new = {b for a, b in pairs if a in new and b is not None and b not in want}
            want |= {b: hops for b in new}
        assert {r["node"]: r["hops"] for r in fixpoint.reach(edges, seeds, rounds).collect()} == want


def test_fixpoint_keys(spark):
    """Null keys are equal, and a key's first row stays."""
    start = spark.createDataFrame([(None, 0), (1, 0)], "k int, n int")
    out = fixpoint.fixpoint(start, lambda new, i: new.selectExpr("k", "n + 1 AS n").union(new.selectExpr("k + 1 AS k", "n + 1 AS n")).filter("n < 4"), ["k"])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0), (2, 1), (3, 2), (4, 3), (None, 0)]


def given_vectors(spark, n, rng, ties=True):
    centres = rng.normal(size=(8, 12))
    made = [(i, (centres[i % 8 if i % 3 else 0] + rng.normal(size=12) * 0.4).tolist()) for i in range(n)]
    made += [(n, None), (n + 1, [0.0] * 12)] + ([(n + 2 + i, made[5][1]) for i in range(15)] if ties else [])
    return made, spark.createDataFrame(made, "id long, v array<double>")


@pytest.mark.parametrize("rows, queries", [(20_000, 2_000), (37, 5)])
def test_exact_neighbours(spark, monkeypatch, rows, queries):
    """In one block and in many, with equal vectors, a zero and a null one."""
    monkeypatch.setattr(neighbours, "ROW_BLOCK", rows)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", queries)
    made, df = given_vectors(spark, 150, np.random.default_rng(1))
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in made if v}
    want = {(q, p + 1, i, s) for q in unit if q % 10 == 0 for p, (s, i) in enumerate(sorted(((round(float(unit[q] @ u), 9) + 0.0, i) for i, u in unit.items()), key=lambda x: (-x[0], x[1]))[:6])}
    got = neighbours.search(df, df.filter("id % 10 = 0"), "id", "v", 6).collect()
    assert {(r["query"], r["place"], r["id"]) for r in got} == {x[:3] for x in want} and len(got) == len(want)
    scores = {x[:3]: x[3] for x in want}
    assert all(abs(scores[(r["query"], r["place"], r["id"])] - r["score"]) < 2e-9 for r in got)


def test_cells(spark, monkeypatch):
    """Vectors in clusters, one of them with a third of all: few probes find nearly all, blocks or not; all cells find all."""
    made, df = given_vectors(spark, 1200, np.random.default_rng(2), ties=False)
    queries = df.filter("id % 20 = 0")
    exact = {(r["query"], r["id"]) for r in neighbours.search(df, queries, "id", "v", 10).collect()}
    some = {(r["query"], r["id"]) for r in neighbours.search(df, queries, "id", "v", 10, 12, 3).collect()}
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    again = {(r["query"], r["id"]) for r in neighbours.search(df, queries, "id", "v", 10, 12, 3).collect()}
    every = {(r["query"], r["id"]) for r in neighbours.search(df, queries, "id", "v", 10, 12, 12).collect()}
    assert len(exact & some) >= 0.9 * len(exact) and some == again and every == exact
    assert neighbours.search(df.limit(0), queries.limit(0), "id", "v", 3, 4, 2).count() == 0
    assert neighbours.fit(df, "v", 5).shape == (5, 12) and len(neighbours.fit(df, "v", 3000, 40)) == 40


def test_samples(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'a', IF(id < 20, NULL, 'b')) AS g", "IF(id % 7 = 0, NULL, CAST(id % 5 AS DOUBLE)) AS number")
    one = samples.stratified(rows, ["g"], "id", 30)
    found = one.collect()
    assert one.columns == rows.columns and sorted(map(str, found)) == sorted(map(str, samples.stratified(rows.repartition(7), ["g"], "id", 30).collect()))
    assert {g: sum(r["g"] == g for r in found) for g in ("a", "b", None)} == {"a": 30, "b": 30, None: 13}
    assert set(map(str, found)) != set(map(str, samples.stratified(rows, ["g"], "id", 30, 2).collect()))
    assert "WindowGroupLimit" in plan(one)
    by_weight = samples.weighted(rows, "id", "number", 1000)
    counts = {r["number"]: r["count"] for r in by_weight.groupBy("number").count().collect()}
    assert sum(counts.values()) == 1000 and set(counts) == {1.0, 2.0, 3.0, 4.0} and counts[4.0] > counts[2.0] > counts[1.0]
    assert "TakeOrderedAndProject" in plan(by_weight)
    each = samples.weighted(rows, "id", "number", 5, strata=["g"])
    assert "WindowGroupLimit" in plan(each) and sorted(r["count"] for r in each.groupBy("g").count().collect()) == [5, 5, 5]


def test_uniform(spark):
    """The stated bits of the hash, spread evenly."""
    got = [r[0] for r in spark.range(2000).select(samples.uniform(F.col("id"), 3)).collect()]
    import hashlib

    assert got[:50] == [(int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(50)]
    assert abs(np.mean(got) - 0.5) < 4 * math.sqrt(1 / 12 / 2000) and 0 < min(got) < max(got) < 1


def test_variant_scan(spark):
    """Only the columns used are read; text that is no JSON is a null variant."""
    rows = beyond.stored_variants(spark, DATA)
    assert re.search(r"ReadSchema: struct<event_type:string,v:(variant|struct)", plan(QUERIES["stored_variant"](spark, DATA)))
    assert dict(rows.dtypes)["v"] == "variant"
    bad = spark.sql("SELECT try_parse_json(x) AS v FROM VALUES ('{\"k\": [1, 2]}'), ('{'), (NULL) AS t(x)")
    assert bad.filter("v IS NULL").count() == 2 and bad.agg(F.schema_of_variant_agg("v")).first()[0] == "OBJECT<k: ARRAY<BIGINT>>"


@pytest.fixture()
def source(spark):
    segments.register(spark)
    return spark


def test_source_round_trip(source, tmp_path):
    """Appended and replaced, of any types, empty too; several commits are one table."""
    path = f"file://{tmp_path}/t"
    rows = source.range(1000).selectExpr("id", "IF(id % 4 = 0, NULL, CAST(id AS STRING)) AS s", "array(id) AS a", "timestamp_ntz'2024-01-01' AS t", "id / 3D AS x").repartition(3)
    for part in (rows.filter("id < 500"), rows.filter("id >= 500"), rows.limit(0)):
        part.write.format("segments").mode("append").save(path)
    back = source.read.format("segments").load(path)
    assert back.schema == rows.schema and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    rows.filter("id = 3").write.format("segments").mode("overwrite").save(path)
    assert [r["id"] for r in source.read.format("segments").load(path).collect()] == [3]
    with pytest.raises(Exception, match="nothing was written"):
        source.read.format("segments").load(f"{tmp_path}/other").count()


def test_source_filters(source, tmp_path):
    """Comparisons are applied by the source, which leaves out segments; what it doesn't know, Spark filters."""
    path = f"{tmp_path}/t"
    for low in (0, 100, 200):
        source.range(low, low + 100, 1, 1).selectExpr("id", "IF(id % 2 = 0, 'even', 'odd') AS s", "IF(id % 9 = 0, NULL, CAST(id AS DOUBLE)) AS x").write.format("segments").mode("append").save(path)
    load = lambda filters: source.read.format("segments").option("filters", filters).load(path)
    again = load("false")
    for condition in ("id >= 150", "id < 10 AND s = 'odd'", "s > 'f'", "x > 120", "x IS NULL AND id <= 20", "id = 42 OR id = 250", "s LIKE 'e%' AND id > 290", "id = -5", "NOT id = 7"):
        want = [i for i in source.range(300).selectExpr("id", "IF(id % 2 = 0, 'even', 'odd') AS s", "IF(id % 9 = 0, NULL, CAST(id AS DOUBLE)) AS x").filter(condition).collect()]
        for read in (load("true"), again):
            assert sorted(map(str, read.filter(condition).collect())) == sorted(map(str, want)), condition
    reader = segments.Segments({"path": path, "filters": "true"}).reader(again.schema)
    left = list(reader.pushFilters([segments.d.GreaterThanOrEqual(("id",), 150), segments.d.EqualTo(("x",), 3.0)]))
    assert len(left) == 1 and len(reader.partitions()) == 2
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 150


def test_failed_write_leaves_nothing(source, tmp_path):
    """A task that fails deletes its segment, there is no manifest, and what killed tasks leave is cleaned away, but nothing else."""
    rows = source.range(0, 400, 1, 4).selectExpr("id", "IF(id = 399, raise_error('no'), 1) AS v")
    with pytest.raises(Exception, match="no"):
        rows.selectExpr("id", "CAST(v AS INT) AS v").write.format("segments").mode("append").save(f"{tmp_path}/t")
    store = segments.Store(f"{tmp_path}/t")
    assert store.manifests() == []
    source.range(5).write.format("segments").mode("append").save(f"{tmp_path}/t")
    store.clean()
    assert store.clean() == 0 and source.read.format("segments").load(f"{tmp_path}/t").count() == 5
    source.range(0).write.format("segments").mode("overwrite").save(f"{tmp_path}/t")
    store = segments.Store(f"{tmp_path}/u")
    with pytest.raises(RuntimeError):
        store.write(x for x in [pa.RecordBatch.from_pydict({"a": [1]}), (_ for _ in ()).throw(RuntimeError)])
    assert not list((tmp_path / "u" / "data").glob("*"))


def test_source_stream(source, tmp_path):
    """Offsets go on where the last run ended; a batch that is committed again counts once."""
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    for low in (0, 50):
        source.range(low, low + 50).write.format("segments").mode("append").save(a)
        stream = source.readStream.format("segments").load(a)
        stream.writeStream.format("segments").option("path", b).option("stream", "x").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["id"] for r in source.read.format("segments").load(b).collect()) == list(range(low + 50))
    writer = segments.Segments({"path": b, "stream": "x"}).streamWriter(stream.schema, False)
    known = len(writer.store.manifests())
    writer.commit([writer.write(iter([pa.RecordBatch.from_pydict({"id": [7]})])), None], 0)
    assert len(writer.store.manifests()) == known and source.read.format("segments").load(b).count() == 100
    writer.abort([writer.write(iter([pa.RecordBatch.from_pydict({"id": [7]})])), None], 9)
    assert source.read.format("segments").load(b).count() == 100


def test_outer_join_waits_for_the_watermark(spark):
    """Rows without a match come out only when later rows on both sides let the watermark pass them."""
    at = lambda h: f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {h})"
    rows = lambda values: spark.createDataFrame(values, "id long, k long, h int, side string").selectExpr("id", "k", f"{at('h')} AS ts", "side")
    replay = sinks.Replay(spark, "outer", [rows([(1, 1, 0, "l"), (2, 2, 0, "l"), (3, 1, 1, "r"), (4, 2, 9, "r")]), rows([(5, 0, 40, "l"), (6, 9, 40, "r")])])
    side = lambda s: replay.stream.filter(F.col("side") == s).select("id", "k", "ts")
    pairs = windows.outer_interval_join(side("l"), side("r"), "k", "ts", "2 HOURS").select(F.col("l.id").alias("l"), F.col("r.id").alias("r"))
    assert sorted(map(tuple, sinks.to_table(pairs, "outer", "append", replay).collect())) == [(1, 3), (2, None)]


def test_sessions_by_timers(spark):
    """Rows in any order merge sessions, also two that were apart; open ones stay in the state, and the map counts all rows."""
    rows = lambda values: spark.createDataFrame(values, "k long, m int, kind string").selectExpr("k", "timestamp_seconds(m * 60 + 86400) AS ts", "kind")
    replay = sinks.Replay(spark, "timers", [rows([(1, 0, "a"), (1, 20, "b"), (2, 0, "a")]), rows([(1, 10, "a"), (1, 60, "a")]), rows([(3, 300, "z")]), rows([(3, 301, "z")])])
    from sparkloom.session import scratch

    place = scratch(spark, "timers")
    with state.rocks(spark):
        out = sinks.to_table(state.sessions_by_state(replay.stream, "k", "ts", "kind", 10 * 60_000), "timers", "append", replay, place)
    minute = 60_000
    out = out.selectExpr("key", "start - 86400000", "end - 86400000", "n")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 20 * minute, 3), (1, 60 * minute, 60 * minute, 1), (2, 0, 0, 1)]
    left = state.state_rows(spark, place, "open").collect()
    assert [r["key"]["key"] for r in left] == [3]
    kinds = {(r["key"]["key"], r["user_map_key"]["kind"]): r["user_map_value"]["n"] for r in state.state_rows(spark, place, "kinds").collect()}
    assert kinds == {(1, "a"): 3, (1, "b"): 1, (2, "a"): 1, (3, "z"): 2}


def test_first_seen_forgets(spark):
    """With a time to live that is over at once, kinds are new again in the next batch; with a long one they aren't."""
    import time

    rows = lambda values: spark.createDataFrame(values, "k long, kind string")
    for ttl, want in ((1, 4), (3_600_000, 3)):
        replay = sinks.Replay(spark, "ttl", [rows([(1, "a"), (1, "b")]), rows([(1, "a"), (2, "a")])])
        with state.rocks(spark), state.only_with_rows(spark):
            out = sinks.to_table(state.first_seen(replay.stream, "k", "kind", ttl), "ttl", "update", replay)
        assert out.count() == want
        time.sleep(0.01)
