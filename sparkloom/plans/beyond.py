"""Queries of bucketed tables, recursion over data, vector search, samples of exact size and stored variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import fixpoint, neighbours, samples
from ..session import table
from ..sources.bucketed import bucketed
from ..stored import save
from .registered import query

BUCKETS = 16
CELLS, PROBES, BEST = 16, 12, 10  # the given vectors have few clusters, so most cells are looked at


@query("bucketed_join", """SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, max(o_totalprice) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders in buckets of the order: the join and the sums by order need no exchange."""
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "lines", ["l_orderkey"], BUCKETS)
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "orders", ["o_orderkey"], BUCKETS)
    joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("o_totalprice").alias("p"))


@query("bucketed_without", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05)")
def bucketed_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a large discount, by an anti join of buckets."""
    lines = bucketed(table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select("l_orderkey"), "lines", ["l_orderkey"], BUCKETS)
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "orders", ["o_orderkey"], BUCKETS)
    return orders.join(lines.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


def bought_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, item): customers and what they bought, a part of a supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("k", F.struct("l_partkey", "l_suppkey").alias("item")).distinct()


@query("linked_customers", """WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT o_custkey AS k, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    e AS MATERIALIZED (SELECT DISTINCT x.k AS a, y.k AS z FROM b x JOIN b y ON x.p = y.p AND x.s = y.s AND x.k <> y.k),
    r(node, hops) AS (SELECT min(o_custkey), 0 FROM orders UNION SELECT z, hops + 1 FROM r JOIN e ON node = a WHERE hops < 30) SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node""")
def linked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each customer is from the first one, over parts that two of them bought of the same supplier. A step goes by way of the
    parts, so customers are never paired."""
    bought = save(bought_alike(spark, sf_dir), "bought")

    def step(new: DataFrame, number: int) -> DataFrame:
        items = new.join(bought, F.col("node") == F.col("k")).select(F.col("item").alias("met")).distinct()
        return items.join(bought, F.col("met") == F.col("item")).select(F.col("k").alias("node"), F.lit(number).cast("long").alias("hops"))

    first = table(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("node")).select("node", F.lit(0).cast("long").alias("hops"))
    return fixpoint.fixpoint(first, step, ["node"])


def vectors_and_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and those with an id divisible by 20, the stated queries."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows, rows.filter("vec_id % 20 = 0")


@query("vector_nearest", """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)
    SELECT query, place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM
    (SELECT q.vec_id AS query, r.vec_id AS id, round(list_inner_product(q.u, r.u), 9) AS score FROM v q, v r WHERE q.vec_id % 20 = 0)) WHERE place <= 10""")
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of each query, exactly."""
    return neighbours.search(*vectors_and_queries(spark, sf_dir), "vec_id", "embedding", BEST)


@query("vector_cells")
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the inverted file."""
    return neighbours.search(*vectors_and_queries(spark, sf_dir), "vec_id", "embedding", BEST, CELLS, PROBES)


@query("vector_recall", "SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS queries, true AS reached FROM embeddings")
def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted file finds nine of ten of what the exact search does, over all queries. Of equal scores any counts."""
    exact = vector_nearest(spark, sf_dir).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    found = vector_cells(spark, sf_dir).select(F.col("query").alias("q"), "score")
    hits = exact.join(found, (F.col("query") == F.col("q")) & (F.col("score") >= F.col("least")), "left").groupBy("query").agg(F.first("n").alias("n"), F.count("score").alias("hits"))
    return hits.agg(F.count("*").alias("queries"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("reached"))


@query("sample_by_stratum", """SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ('0x' || substr(md5('7:' || o_orderkey::VARCHAR), 1, 13))::BIGINT, o_orderkey) AS n FROM orders) WHERE n <= 40""")
def sample_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty orders of each status (a sampling operator)."""
    return samples.stratified(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey", 40, 7)


@query("sample_by_weight", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0
    ORDER BY -ln((('0x' || substr(md5('7:' || o_orderkey::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / o_totalprice, o_orderkey LIMIT 100""")
def sample_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred orders, by their price (a sampling operator)."""
    return samples.weighted(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100, 7)


def stored_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their props as a variant, written and read back."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.try_parse_json("props").alias("v"))
    return save(events, "variants")


@query("stored_variant", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS s, 'OBJECT<k: BIGINT>' AS shape FROM events GROUP BY event_type")
def stored_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_variants(spark, sf_dir)
    return rows.groupBy("event_type").agg(F.count("v").alias("n"), F.sum(F.variant_get("v", "$.k", "bigint")).alias("s"), F.schema_of_variant_agg("v").alias("shape"))


@query("sink_noop", "SELECT count(*) AS n, sum(l_quantity) AS q, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def sink_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines into the sink that keeps nothing; what is observed on the way is one row."""
    seen = Observation("lines")
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    flags = F.size(F.collect_set("l_returnflag")).cast("long")
    rows.observe(seen, F.count("*").alias("n"), F.sum("l_quantity").alias("q"), flags.alias("flags")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["q"], seen.get["flags"])], "n long, q double, flags long")
