"""Running values dealt by ranges against one window over everything."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered

ALL = {
    "number": ("row_number",), "place": ("rank",), "dense": ("dense_rank",), "share": ("percent_rank",), "upto": ("cume_dist",), "third": ("ntile", 3), "many": ("ntile", 90),
    "n": ("count", "v"), "s": ("sum", "v"), "a": ("avg", "v"), "least": ("min", "v"), "most": ("max", "v"),
}


def plainly(rows, keys, order, peers):
    by = Window.partitionBy(*keys).orderBy(*ordered.directed(order))
    frame = by.rangeBetween(Window.unboundedPreceding, 0) if peers else by.rowsBetween(Window.unboundedPreceding, 0)
    own = {
        "number": F.row_number().over(by), "place": F.rank().over(by), "dense": F.dense_rank().over(by), "share": F.percent_rank().over(by), "upto": F.cume_dist().over(by), "third": F.ntile(3).over(by), "many": F.ntile(90).over(by),
        "n": F.count("v").over(frame), "s": F.sum("v").over(frame), "a": F.avg("v").over(frame), "least": F.min("v").over(frame), "most": F.max("v").over(frame),
    }
    return rows.select(*rows.columns, *[c.alias(name) for name, c in own.items()])


def same(a, b):
    near = lambda x: round(x, 9) if isinstance(x, float) else x
    assert sorted(str([near(x) for x in r]) for r in a.collect()) == sorted(str([near(x) for x in r]) for r in b.collect())


@pytest.fixture(scope="module")
def rows(spark):
    """A key with most rows, null keys, nulls in order and value, and an id that tells rows apart."""
    return spark.range(400).selectExpr(
        "id", "CASE WHEN id % 10 < 6 THEN 'hot' WHEN id % 10 = 6 THEN NULL ELSE CAST(id % 37 AS STRING) END AS key",
        "IF(id % 13 = 0, NULL, id * 7919 % 53) AS at", "IF(id % 4 = 0, NULL, id * 31 % 101) AS v", "id AS part",
    ).repartition(3, "id")


@pytest.mark.parametrize("parts", [1, 15])
@pytest.mark.parametrize("keys, order, peers", [([], ["at", "id"], False), ([], ["-at", "id"], False), (["key"], ["at", "-id"], False), (["key"], ["id"], True)])
def test_running(rows, keys, order, peers, parts):
    same(ordered.running(rows, keys, order, ALL, peers, parts), plainly(rows, keys, order, peers))


@pytest.mark.parametrize("order", [["at"], ["-at"]])
def test_ties(rows, order):
    """Places that don't depend on the sequence of equal rows, and frames that hold all of them."""
    made = {k: v for k, v in ALL.items() if v[0] not in ("row_number", "ntile")}
    same(ordered.running(rows, [], order, made, True, 9), plainly(rows, [], order, True).drop("number", "third", "many"))


def test_one_key_is_dealt_over_all_tasks(spark):
    """All rows of one key: no task has more than a range, and the carried table a row for each."""
    rows = spark.range(20_000).selectExpr("'x' AS key", "id AS at", "1L AS v")
    ranged = ordered.in_ranges(rows, ["key"], ["at"], "part", 8)
    sizes = [r["count"] for r in ranged.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000
    assert ordered.cut_keys(ranged, ["key"], "part").count() == 1
    side = ordered.carried(ranged, ["key"], "part", {"n": F.count("*")}, {"n": ("n", F.sum)})
    assert side.count() == 8 and sorted(r["n"] or 0 for r in side.collect())[-1] == 20_000 - [r["count"] for r in ranged.groupBy("part").count().orderBy(F.desc("part")).collect()][0]
    out = ordered.running(rows, ["key"], ["at"], {"s": ("sum", "v")}, parts=8)
    assert out.filter("s <> at + 1").count() == 0 and out.count() == 20_000


def test_whole_keys_are_not_carried(spark):
    rows = spark.range(1000).selectExpr("id AS key", "id AS at", "id AS v")
    ranged = ordered.in_ranges(rows, ["key"], ["at"], "part", 6)
    assert ordered.cut_keys(ranged, ["key"], "part").count() == 0
    same(ordered.running(rows, ["key"], ["at"], {"s": ("sum", "v")}, parts=6), rows.selectExpr("*", "v AS s"))


def test_edges(spark, rows):
    assert ordered.running(rows.limit(0), [], ["at"], ALL).collect() == []
    for made, order in (({"x": ("median", "v")}, ["at"]), ({"x": ("rank",)}, [])):
        with pytest.raises(ValueError):
            ordered.running(rows, [], order, made)
