"""The plans are the ones meant: what is pushed down, broadcast, aggregated before the exchange, and limited early."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import joins, ranks, windows
from sparkloom.plans.catalogue import QUERIES
from sparkloom.session import table
from sparkloom.sql import guarded

DATA = "/root/testdata/sf0.001"


def plan(rows, mode="formatted"):
    return rows.sparkSession._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), mode)


def query_plan(spark, name):
    return plan(QUERIES[name](spark, DATA))


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pushdown_and_pruning(spark):
    text = query_plan(spark, "filter_project")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_quantity,10.0\)", text)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>", text)


def test_revenue_reads_few_columns(spark):
    text = query_plan(spark, "revenue_by_nation")
    assert "BroadcastHashJoin" in text and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in text


def test_sort_merge(spark, no_broadcast):
    text = query_plan(spark, "interval_join")
    assert "SortMergeJoin" in text and "CartesianProduct" not in text


def test_shuffled_hash(spark, no_broadcast):
    assert "ShuffledHashJoin" in query_plan(spark, "hash_join")


def test_nested_loop_where_asked(spark):
    assert all("NestedLoop" in query_plan(spark, name) for name in ("theta_join", "cross_join", "sample"))


@pytest.mark.parametrize("name, node", [("pricing_summary", "HashAggregate"), ("collected", "ObjectHashAggregate"), ("arg_extremes", "SortAggregate")])
def test_aggregates_before_the_exchange(spark, name, node):
    text = query_plan(spark, name).split("\n\n")[0]
    assert re.search(rf"{node}[^\n]*\n([^\n]*Sort [^\n]*\n)?[^\n]*Exchange[^\n]*\n[^\n]*{node}", text), text


def test_sort_aggregate(spark):
    assert "SortAggregate" in plan(table(spark, DATA, "part").groupBy("p_size").agg(F.max("p_name")))


def test_limits(spark):
    assert "TakeOrderedAndProject" in query_plan(spark, "top_orders")
    for name in ("top_per_key", "distinct_on", "qualify"):
        text = query_plan(spark, name).split("\n\n")[0]
        assert text.count("WindowGroupLimit") == 2, name


def test_asof_needs_one_exchange(spark):
    assert plan(QUERIES["asof_join"](spark, DATA)).split("\n\n")[0].count("Exchange") == 1


def percentiles_equal(rows, share, **how):
    got = {r["g"]: r["p"] for r in ranks.percentile(rows, ["g"], "v", share, "p", **how).collect()}
    built_in = F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY v)") if how.get("discrete") else F.percentile("v", F.lit(share))
    want = {r["g"]: r["p"] for r in rows.groupBy("g").agg(built_in.alias("p")).collect() if r["p"] is not None}
    near = lambda a, b: a == b or a != a and b != b or abs(a - b) <= 1e-9 * abs(b)
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want), (share, how, got, want)
    return got


@pytest.mark.parametrize("share, how", [*[(s, {}) for s in (0.0, 0.00015, 0.5, 0.9, 0.99995, 1.0)], (0.5, {"bins": 3}), (0.9, {"discrete": True})])
def test_percentile(spark, share, how):
    """Ties, few rows, groups of one, nulls, a null key; both bounds of the range; several rounds."""
    rows = spark.range(20_000).selectExpr("IF(id % 5 = 0, NULL, id % 3) AS g", "IF(id % 7 = 0, NULL, CAST(pow(id % 997, 2) AS DOUBLE)) AS v")
    rows = rows.union(spark.sql("SELECT 7L, 5D UNION ALL SELECT 8L, NULL"))
    assert percentiles_equal(rows, share, **how)[7] == 5


@pytest.mark.parametrize("share", [0.1, 1 / 3, 0.9])
def test_percentile_of_few_rows(spark, share):
    """Groups of 1 to 60 rows without ties: places at the bounds of the sketch."""
    rows = spark.range(61 * 61).selectExpr("id div 61 AS g", "id % 61 AS i", "CAST(hash(id) AS DOUBLE) AS v").filter("i < g")
    for discrete in (False, True):
        assert len(percentiles_equal(rows, share, discrete=discrete)) == 60


@pytest.mark.parametrize("share", [0.001, 0.5, 0.75])
def test_percentile_of_any_doubles(spark, monkeypatch, share):
    """Magnitudes far apart, heavy ties, signs, zeros, infinite values and numbers that differ in the last bit; the sketch sees one bound only."""
    monkeypatch.setattr(ranks, "ACCURACY", 2)
    values = [f"pow(-1, id) * pow(10D, (id * 37) % 600 - 300) AS v", "IF(id % 3 = 0, 1D, 1D + id * 2.220446049250313e-16) AS v", "IF(id % 10 < 8, 5D, id - 500D) AS v", "IF(id % 2 = 0, 0D, -0D) AS v", "CASE WHEN id % 4 = 0 THEN double('inf') WHEN id % 4 = 1 THEN double('-inf') ELSE id END AS v", "IF(id % 2 = 0, double('nan'), id) AS v"]
    parts = [spark.range(1000).selectExpr(f"{g} AS g", v) for g, v in enumerate(values)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    percentiles_equal(rows, share, discrete=True)
    percentiles_equal(rows.filter("g < 4"), share)


def test_percentile_orders_nothing(spark):
    """No exchange of rows to one task, and no window."""
    rows = table(spark, DATA, "orders")
    text = plan(ranks.percentile(rows, [], "o_totalprice", 0.99, "p"))
    assert "Window" not in text and "Sort" not in text
    band = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS v", "1L AS c")
    state = spark.sql("SELECT 5000L AS n, 0D AS low, 4999D AS high, 0L AS below")
    text = plan(ranks.narrowed(band, state, [], 0.5, False, 100, ("low", "high", "n", "below", "v", "c")))
    assert "Window" not in text and not re.search(r"SinglePartition(?s:.){0,200}Range", text.split("\n\n")[0])


def test_range_join_of_any_span(spark):
    """Spans of any length and sign, reversed and null bounds, numbers with fractions, columns named like inner ones."""
    points = spark.range(200).selectExpr("id AS level", "CAST(id AS DOUBLE) * 3.7 - 250 AS x")
    spans = spark.range(60).selectExpr("id AS bucket", "CAST(id * 11 % 97 AS DOUBLE) - 90 AS low", "CAST(id * 11 % 97 AS DOUBLE) - 90 + pow(id, 2) / 3 - 5 AS high")
    spans = spans.union(spark.sql("SELECT 100L, 500D, 0D UNION ALL SELECT 101L, NULL, 9D UNION ALL SELECT 102L, -1e9D, 1e9D"))
    got = sorted((r["level"], r["bucket"]) for r in joins.range_join(points, spans, "x", "low", "high", 10).collect())
    want = sorted((p["level"], s["bucket"]) for p in points.collect() for s in spans.collect() if s["low"] is not None and s["low"] <= p["x"] <= s["high"])
    assert got == want and len(got) > 1000
    assert joins.range_join(points, spans.limit(0), "x", "low", "high", 10).count() == 0


def test_asof_edges(spark):
    """Columns named like inner ones, nulls in time and key, ties in distance, a tolerance in numbers."""
    left = spark.createDataFrame([("a", 10, 1), ("a", None, 2), (None, 10, 3), ("b", 10, 4), ("a", 99, 5)], "side string, at int, l int")
    right = spark.createDataFrame([("a", 8, "x"), ("a", 12, "y"), (None, 10, "z"), ("a", None, "n")], "side string, at int, h string")
    run = lambda *how: {r["l"]: r["h"] for r in joins.asof_join(left, right, "at", ["side"], ["h"], *how).collect()}
    assert run() == {1: "x", 2: None, 3: None, 4: None, 5: "y"}
    assert run("forward") == {1: "y", 2: None, 3: None, 4: None, 5: None}
    assert run("nearest") == {1: "x", 2: None, 3: None, 4: None, 5: "y"}
    assert run("nearest", F.lit(20)) == {1: "x", 2: None, 3: None, 4: None, 5: None}
    with pytest.raises(ValueError):
        run("sideways")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("parts", [1, 6])
def test_asof_by_ranges(spark, direction, by, parts):
    """A hot key, many equal times, nulls, values that are null: as the join by keys gives them."""
    left = spark.range(300).selectExpr("id", "IF(id % 29 = 0, NULL, IF(id % 10 < 7, 'hot', CAST(id % 4 AS STRING))) AS k", "IF(id % 31 = 0, NULL, id * 17 % 40) AS at")
    right = spark.range(60).selectExpr("IF(id % 19 = 0, NULL, IF(id % 10 < 6, 'hot', CAST(id % 4 AS STRING))) AS k", "IF(id % 23 = 0, NULL, id * 13 % 60 + 3) AS at", "IF(id % 5 = 0, NULL, id) AS side").dropDuplicates(["k", "at"])
    if not by:
        left, right = left.drop("k"), right.drop("k").dropDuplicates(["at"])
    for tolerance in (None, F.lit(2)) if parts == 6 else (None,):
        got = joins.asof_join(left, right, "at", by, ["side", "at"][:1], direction, tolerance, parts)
        key = left.withColumn("one", F.lit(1)), right.withColumn("one", F.lit(1))
        want = joins.asof_join(*key, "at", [*by, "one"], ["side"], direction, tolerance).drop("one")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_asof_hot_key_is_dealt(spark):
    left = spark.range(8_000).selectExpr("id", "'x' AS k", "id * 2 AS at")
    right = spark.range(100).selectExpr("'x' AS k", "id * 160 AS at", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = joins.asof_join(left, right, "at", ["k"], ["v"], ranges=16)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.filter("v <> floor(at / 160)").count() == 0 and out.count() == 8_000 and max(sizes) < 5_000
    assert "hashpartitioning(part" in plan(joins.asof_join(left, right, "at", [], ["v"]))


@pytest.mark.parametrize("text", ["SELECT * FROM a ASOF JOIN b ON x = y", "select * from a asof left join b using (k)", "FROM a positional\n join b"])
def test_unknown_joins_are_refused(text):
    with pytest.raises(ValueError):
        guarded(text)


@pytest.mark.parametrize("text", ["SELECT 'a asof join b'", "SELECT asof FROM t JOIN u -- positional join", "SELECT `positional` FROM a LEFT JOIN b USING (k)"])
def test_other_text_passes(text):
    assert guarded(text) == text


@pytest.mark.parametrize("what", ["current row", "group", "ties"])
@pytest.mark.parametrize("before, after", [(3, 2), (0, 4), (2, 0), (0, 0)])
def test_excluding(spark, what, before, after):
    """All aggregates over one frame, with ties, nulls, infinite values and NaN, against lists."""
    rows = spark.range(120).selectExpr("id", "id % 3 AS k", "id * 7 % 11 AS at", "IF(id % 5 = 0, NULL, id * 13 % 37) AS v", "CASE WHEN id % 17 = 0 THEN double('nan') WHEN id % 13 = 0 THEN double('inf') WHEN id % 19 = 0 THEN double('-inf') WHEN id % 6 = 0 THEN NULL ELSE id / 7D END AS rank")
    rows = rows.withColumn("at", F.struct("at", (F.col("id") % 2).alias("x")))
    made = {f"{how}_{c}": (how, c) for how in windows.AGGREGATES for c in ("v", "rank")}
    got = {r["id"]: r for r in windows.excluding(rows, ["k"], "at", before, after, made, what).collect()}
    for k in range(3):
        # The sequence of ties is the window's own, so it is read off a count that has no ties.
        own = rows.filter(f"k = {k}").withColumn("n", F.row_number().over(windows.Window.partitionBy("k").orderBy("at"))).orderBy("n").collect()
        for i, r in enumerate(own):
            inside = [x for j, x in enumerate(own) if i - before <= j <= i + after and {"current row": j != i, "group": x["at"] != r["at"], "ties": x["at"] != r["at"] or j == i}[what]]
            for c in ("v", "rank"):
                values = [x[c] for x in inside if x[c] is not None]
                nan = [x for x in values if x != x]
                want = (len(values), sum(values) if values else None, sum(values) / len(values) if values else None, min([x for x in values if x == x], default=nan[0] if nan else None), nan[0] if nan else max(values, default=None))
                near = lambda a, b: a == b or (a is not None and b is not None and (a != a and b != b or abs(a - b) < 1e-9))
                found = [got[r["id"]][f"{how}_{c}"] for how in ("count", "sum", "avg", "min", "max")]
                assert all(map(near, found, want)), (what, before, after, r, found, want)
