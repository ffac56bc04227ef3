"""The queries of the relational core, each with its SQL for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import joins, ranks, windows
from ..session import table
from . import analytics, beyond, scalars, streams, user_code  # noqa: F401  (they register their queries)
from .registered import ORACLES, QUERIES, query, statement

__all__ = ["ORACLES", "QUERIES"]

@query(
    "revenue_by_nation",
    """SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name""",
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n_lines"))


# Filters, projections, subqueries.
statement("filter_project", "SELECT l_orderkey, l_quantity * 2 AS twice FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')")
statement("like_filter", "SELECT p_partkey, upper(p_name) AS name FROM {part} WHERE p_name LIKE '%e%'")
statement("exists_subquery", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
statement("not_in_subquery", "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 40)")
statement("scalar_subquery", "SELECT c_custkey, c_acctbal FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})")
# Joins.
statement("left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
statement("full_join", "SELECT o_orderkey, l_orderkey, count(*) AS n FROM {orders} FULL JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey, l_orderkey")
statement("semi_join", "SELECT n_nationkey FROM {nation} LEFT SEMI JOIN {customer} ON n_nationkey = c_nationkey", "SELECT n_nationkey FROM nation SEMI JOIN customer ON n_nationkey = c_nationkey")
statement("anti_join", "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
# Aggregation.
statement("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, avg(l_extendedprice) AS price, min(l_discount) AS least, max(l_tax) AS most, count(*) AS n
    FROM {lineitem} GROUP BY l_returnflag, l_linestatus""")
statement("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag")
statement("filtered_aggregate", "SELECT event_type, count(*) FILTER (WHERE value > 100) AS n FROM {events} GROUP BY event_type")
statement("rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
statement("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
statement("grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
statement("statistics", "SELECT l_returnflag, stddev_samp(l_quantity) AS sd, var_pop(l_tax) AS v, corr(l_quantity, l_extendedprice) AS r FROM {lineitem} GROUP BY l_returnflag")
statement("having", "SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
# Windows.
statement("ranking", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(ntile(4) OVER w AS BIGINT) AS q FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
statement("lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
statement("moving_sum", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM {events}")
# Sort, top-k, set operations, recursion.
statement("top_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
statement("union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey AS k FROM {region}")
statement("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
statement("except", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 40")
statement("recursion", """WITH RECURSIVE walk(region, nation, steps) AS (SELECT n_regionkey, min(n_nationkey), CAST(1 AS BIGINT) FROM {nation} GROUP BY n_regionkey
    UNION ALL SELECT region, n_nationkey, steps + 1 FROM walk JOIN {nation} ON n_regionkey = region AND n_nationkey = nation + 5) SELECT region, nation, steps FROM walk""")
# Scalars.
statement("strings", "SELECT p_partkey, trim(substr(p_name, 1, 5)) AS s, lpad(p_brand, 12, '*') AS l, reverse(p_type) AS r, md5(p_name) AS m, levenshtein(p_name, p_brand) AS d FROM {part}",
    "SELECT p_partkey, trim(substr(p_name, 1, 5)) AS s, lpad(p_brand, 12, '*') AS l, reverse(p_type) AS r, md5(p_name) AS m, CAST(levenshtein(p_name, p_brand) AS INT) AS d FROM part")
statement("dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, last_day(CAST(o_orderdate AS DATE)) AS d FROM {orders}")
statement("json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
statement("pivot", "SELECT * FROM (SELECT c_nationkey, c_mktsegment FROM {customer}) PIVOT (count(*) FOR c_mktsegment IN ('BUILDING' AS b, 'MACHINERY' AS m))",
    "SELECT c_nationkey, nullif(count(*) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) AS b, nullif(count(*) FILTER (WHERE c_mktsegment = 'MACHINERY'), 0) AS m FROM customer GROUP BY c_nationkey")
statement("unpivot", "SELECT p_partkey, what, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM {part}) UNPIVOT (amount FOR what IN (size, price))")
statement("tumbling_counts", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, event_type",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, event_type")


@query("median", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS mid FROM lineitem GROUP BY l_returnflag")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.percentile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5, "mid")


@query("high_percentile", "SELECT quantile_cont(o_totalprice, 0.99) AS p FROM orders")
def high_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.percentile(table(spark, sf_dir, "orders"), [], "o_totalprice", 0.99, "p")


@query("asof_join", """SELECT v.event_id, v.user_id, p.value AS price FROM (SELECT * FROM events WHERE event_type = 'view') v
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return joins.asof_join(events.filter("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "ts", ["user_id"], ["price"]).select("event_id", "user_id", "price")


@query("asof_forward", """SELECT v.event_id, p.value AS price FROM (SELECT * FROM events WHERE event_type = 'view') v
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts <= p.ts""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return joins.asof_join(events.filter("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "ts", ["user_id"], ["price"], "forward").select("event_id", "price")


@query("asof_nearest", """SELECT event_id, CASE WHEN gap <= INTERVAL 6 HOUR THEN bought END AS bought FROM (
    SELECT v.event_id, p.event_id AS bought, greatest(v.ts, p.ts) - least(v.ts, p.ts) AS gap,
        row_number() OVER (PARTITION BY v.event_id ORDER BY greatest(v.ts, p.ts) - least(v.ts, p.ts), p.ts) AS n
    FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id) WHERE n = 1""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest purchase of the same user, if it is no further off than six hours."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought"))
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return joins.asof_join(views, bought, "ts", ["user_id"], ["bought"], "nearest", F.expr("INTERVAL 6 HOURS")).select("event_id", "bought")


@query("range_join", "SELECT a.p_partkey, b.s_suppkey FROM part a JOIN supplier b ON a.p_retailprice BETWEEN b.s_acctbal AND b.s_acctbal + 500")
def price_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 500).alias("high"))
    points = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.range_join(points, spans, "p_retailprice", "low", "high", 500).select("p_partkey", "s_suppkey")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.distinct_on(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("groups_frame", "SELECT p_partkey, sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM part")
def brand_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return windows.groups_frame(rows, ["p_brand"], "p_size", 1, 0, F.sum("p_retailprice"), "s").select("p_partkey", "s")


@query("sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 hours")


@query("cosine_to_first", """SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * f.embedding[i]::DOUBLE))
    / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(f.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS c
    FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) f""")
def cosine_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = F.broadcast(rows.filter("vec_id = 0").select(F.col("embedding").alias("other"), F.lit(1).alias("one")))  # one row
    joined = rows.withColumn("k", F.lit(1)).join(first, F.col("k") == F.col("one"))
    return joined.select("vec_id", vectors.cosine(F.col("embedding"), F.col("other")).alias("c"))
