"""What failed on several executors or on larger tables."""

import subprocess
import sys
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sparkloom.operators import joins, neighbours, ordered
from sparkloom.plans.catalogue import QUERIES
from sparkloom.sources import jdbc
from sparkloom.streaming import state

ROOT = str(Path(__file__).parent.parent)


def test_jdbc_on_several_executors(tmp_path):
    """Executors are JVMs of their own, none of which has another's database in memory."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from sparkloom.plans.user_code import jdbc_source
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
rows = jdbc_source(spark, "/root/testdata/sf0.001")
print("parts and rows:", rows.rdd.getNumPartitions(), rows.count())
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=tmp_path)
    assert "parts and rows: 3 15" in done.stdout, done.stderr[-2000:]


def test_sealed_database_keeps_values(spark):
    rows = [(1, 'a, "b"'), (2, None), (3, ""), (4, "Ä\\ñ"), (5, "two\nlines")]
    url = jdbc.sealed(spark.createDataFrame(rows, "k int, v string").repartition(3), "pairs")
    back = jdbc.read(spark, url, "pairs", "k", (0, 5), 2, **jdbc.EMBEDDED)
    assert sorted((r["k"], r["v"]) for r in back.collect()) == sorted(rows)


def vectors(n: int, seed: int) -> pa.Table:
    rng = np.random.default_rng(seed)
    return pa.table({"id": rng.permutation(n), "vector": pa.array(list(rng.integers(-1, 2, (n, 8)).astype(float)), pa.list_(pa.float64()))})


def test_best_of_holds_few_similarities():
    """A block's similarities, 40 million here, are not held at once; ties and vectors that have none come out as before."""
    rows, queries = vectors(neighbours.ROW_BLOCK, 1), vectors(neighbours.QUERY_BLOCK, 2)
    tracemalloc.start()
    got = neighbours.best_of(queries, rows, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
    ids = rows.column("id").to_numpy()
    given, asked = (neighbours.matrix(x.column("vector").combine_chunks()) for x in (rows, queries))
    for q in (0, 999, 1999):
        scores = np.round(given @ asked[q], neighbours.DIGITS)
        best = np.lexsort((ids, -scores))[:10]
        assert got.column("id").to_pylist()[q * 10 : q * 10 + 10] == ids[best].tolist()
        assert np.allclose(got.column("score").to_numpy()[q * 10 : q * 10 + 10], scores[best])


def test_best_of_without_numbers():
    """Of not a number the similarity is the last one."""
    table = lambda *v: pa.table({"id": list(range(len(v))), "vector": pa.array(v, pa.list_(pa.float64()))})
    rows = table([float("nan"), 1.0], [1.0, 0.0], [0.0, 1.0])
    assert neighbours.best_of(table([1.0, 1.0]), rows, 2).column("id").to_pylist() == [1, 2]
    assert neighbours.best_of(table([1.0, 1.0]), rows, 5).column("id").to_pylist() == [1, 2, 0]
    assert neighbours.best_of(table([1.0, 1.0]), rows.slice(0, 0), 5).num_rows == 0


def test_range_join_deals_a_full_bucket(spark, monkeypatch):
    """All points and spans are of one bucket; its pairs are many tasks' work, and each comes once."""
    monkeypatch.setattr(joins, "BLOCK", 100, raising=False)
    points = spark.range(1000).selectExpr("id AS p", "CAST(id % 7 AS DOUBLE) AS at")
    spans = spark.range(300).selectExpr("id AS s", "CAST(id % 5 AS DOUBLE) AS low", "CAST(id % 5 + 2 AS DOUBLE) AS high")
    pairs = joins.range_join(points, spans, "at", "low", "high", 1000)
    by_task = pairs.groupBy(F.spark_partition_id()).count().collect()
    want = sum(1 for p in range(1000) for s in range(300) if s % 5 <= p % 7 <= s % 5 + 2)
    assert sum(r["count"] for r in by_task) == want == pairs.select("p", "s").distinct().count()
    assert max(r["count"] for r in by_task) < 0.2 * want


def shuffled_rows(node) -> int:
    """Rows that the exchanges of a plan that has run wrote."""
    kind, found = node.getClass().getSimpleName(), 0
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}.get(kind)
    if kind == "ShuffleExchangeExec":
        found = node.metrics().apply("shuffleRecordsWritten").value()
    below = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    return found + sum(map(shuffled_rows, below))


def test_range_join_copies_few_rows(spark, monkeypatch):
    """A million pairs of one bucket: rows are copied for blocks, but not for each of thousands of blocks."""
    monkeypatch.setattr(joins, "BLOCK", 20)
    monkeypatch.setattr(joins, "BLOCKS", 16, raising=False)
    points = spark.range(2000).selectExpr("id AS p", "CAST(id % 7 AS DOUBLE) AS at")
    spans = spark.range(500).selectExpr("id AS s", "CAST(id % 5 AS DOUBLE) AS low", "CAST(id % 5 + 2 AS DOUBLE) AS high")
    pairs = joins.range_join(points, spans, "at", "low", "high", 1000)
    assert len(pairs.collect()) == sum(1 for p in range(2000) for s in range(500) if s % 5 <= p % 7 <= s % 5 + 2)
    assert 2500 <= shuffled_rows(pairs._jdf.queryExecution().executedPlan()) < 5 * 2500


def test_range_join_deals_no_span_to_empty_buckets(spark):
    """Points are in a few buckets of many spans."""
    points = spark.range(-10, 10).selectExpr("id AS p", "CAST(id AS DOUBLE) AS at")
    spans = spark.range(-2000, 2000).selectExpr("id AS s", "CAST(id AS DOUBLE) AS low", "CAST(id + 50 AS DOUBLE) AS high")
    pairs = joins.range_join(points.hint("merge"), spans, "at", "low", "high", 50)
    assert len(pairs.collect()) == 20 * 51
    assert 0 < shuffled_rows(pairs._jdf.queryExecution().executedPlan()) < 500


def test_range_join_makes_small_files(spark, monkeypatch, tmp_path):
    """Four million pairs come in an order that files make something of."""
    monkeypatch.setattr(joins, "BLOCK", 1000)
    points = spark.range(2000).selectExpr("id AS p", "CAST(pmod(hash(id), 1000) AS DOUBLE) / 10 AS at")
    spans = spark.range(2000).selectExpr("id AS s", "CAST(pmod(hash(id, 1), 1000) AS DOUBLE) / 10 - 450 AS low").withColumn("high", F.col("low") + 500)
    joins.range_join(points, spans, "at", "low", "high", 500).select("p", "s").write.parquet(str(tmp_path / "pairs"))
    n, size = spark.read.parquet(str(tmp_path / "pairs")).count(), sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert n > 3_000_000 and size < 0.5 * n


@pytest.mark.parametrize("kind", ["DOUBLE", "BIGINT", "DECIMAL(12,2)"])
def test_range_join_in_blocks_of_any_span(spark, monkeypatch, kind):
    """Cut buckets of several levels: nulls in all columns, rows that come twice, reversed spans, chunks that are partly met."""
    monkeypatch.setattr(joins, "BLOCK", 10)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 20, raising=False)
    monkeypatch.setattr(joins, "CHUNK", 16, raising=False)
    points = spark.range(700).selectExpr("IF(id % 11 = 0, NULL, id % 600) AS chunk", f"CAST(IF(id % 13 = 0, NULL, id * 37 % 450 - 150) AS {kind}) AS c0")
    spans = spark.range(300).selectExpr("IF(id % 7 = 0, NULL, id % 200) AS held", f"CAST(IF(id % 17 = 0, NULL, id * 29 % 400 - 200) AS {kind}) AS low", f"CAST(IF(id % 19 = 0, NULL, id * 29 % 400 - 203 + id % 40 * (id % 5)) AS {kind}) AS high")
    got = joins.range_join(points, spans, "c0", "low", "high", 25)
    assert got.dtypes == points.dtypes + spans.dtypes
    missing = lambda rows: sorted(rows, key=lambda r: [(v is not None, v or 0) for v in r])
    want = [(*p, *s) for p in points.collect() for s in spans.collect() if None not in (p[1], s[1], s[2]) and s[1] <= p[1] <= s[2]]
    assert missing(map(tuple, got.collect())) == missing(want) and len(want) > 5000


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """A task's share of an order is a number of rows, not a part of the table."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100, raising=False)
    rows = spark.range(5000).selectExpr("id", "id % 3 AS key")
    ranged = ordered.in_ranges(rows, ["key"], ["id"], "part")
    sizes = [r["count"] for r in ranged.groupBy("part").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 300
    found = ordered.running(rows, ["key"], ["id"], {"n": ("row_number",)})
    assert found.filter("n <> (id - key) / 3 + 1").count() == 0


def test_sessions_have_one_timer_a_key():
    """Fifty open sessions, one timer; when it rings, all that the watermark has passed come out."""

    class Fake:
        def __init__(self):
            self.timers, self.calls, self.rows = set(), 0, []

        def registerTimer(self, t):
            self.timers.add(t)
            self.calls += 1

        def deleteTimer(self, t):
            self.timers.discard(t)

        def listTimers(self):
            return iter(sorted(self.timers))

        def getListState(self, *_):
            return SimpleNamespace(get=lambda: iter(self.rows), put=lambda x: self.__dict__.update(rows=list(x)), clear=self.rows.clear)

        def getMapState(self, *_):
            held = {}
            return SimpleNamespace(getValue=held.get, containsKey=held.__contains__, updateValue=held.__setitem__)

    fake, work = Fake(), state.Sessions(10)
    work.init(fake)
    list(work.handleInputRows((1,), iter([pd.DataFrame({"at": [100 * i for i in range(50)], "kind": ["a"] * 50})]), None))
    assert fake.calls == 1 and fake.timers == {11}
    fake.timers.clear()
    at = lambda t: (SimpleNamespace(getCurrentWatermarkInMs=lambda: t), SimpleNamespace(getExpiryTimeInMs=lambda: 11))
    out = pd.concat(work.handleExpiredTimer((1,), *at(2_011)))
    assert out["start"].tolist() == [100 * i for i in range(21)] and fake.timers == {2_111} and len(fake.rows) == 29


def test_texts_are_unpacked_few_at_once():
    lm = pytest.importorskip("sparkloom.llm.lm_scoring")
    given = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["v"]) for n in (2 * lm.ROWS + 1, 0, 3)]
    got = list(lm.sliced(iter(given)))
    assert max(b.num_rows for b in got) <= lm.ROWS
    assert [v for b in got for v in b.column(0).to_pylist()] == [v for b in given for v in b.column(0).to_pylist()]


def excluded(sizes, keep):
    """(sum, max, count, average) over 200 rows before and after each place, of those that keep says."""
    out = []
    for i in range(len(sizes)):
        inside = [sizes[j] for j in range(max(0, i - 200), min(len(sizes), i + 201)) if keep(i, j)]
        out.append((sum(inside), max(inside), len(inside), sum(inside) / len(inside)) if inside else (None, None, 0, None))
    return out


@pytest.mark.parametrize("name", ["exclude_group", "exclude_ties"])
def test_exclude_gives_one_result_for_ties(spark, tmp_path, name):
    """Equal rows come in an order of their own, not in that of the files: some 150 of a type, in frames of 401 rows."""
    n = 900
    parts = pd.DataFrame({"p_partkey": range(n), "p_brand": "b", "p_type": [f"t{k % 6}" for k in range(n)], "p_size": [k * k % 47 for k in range(n)]})
    parts = parts.astype({"p_size": "int32"})
    found = []
    for i, order in enumerate((parts, parts[::-1], parts.sample(frac=1, random_state=5))):
        (tmp_path / str(i)).mkdir()
        order.to_parquet(tmp_path / str(i) / "part.parquet", index=False)
        found.append(sorted(map(tuple, QUERIES[name](spark, str(tmp_path / str(i))).collect())))
    ordered_rows = parts.sort_values(["p_type", "p_partkey"])
    types, keys, sizes = (ordered_rows[c].tolist() for c in ("p_type", "p_partkey", "p_size"))
    ties = name == "exclude_ties"
    values = excluded(sizes, lambda i, j: types[i] != types[j] or ties and i == j)
    want = sorted((k, *(v[2:] if ties else v[:2])) for k, v in zip(keys, values, strict=True))
    assert found[0] == found[1] == found[2] == want
