"""Queries of predicates, joins, aggregates, windows and set operations beyond the catalogue's first ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, ordered, ranks, windows
from ..session import table
from .registered import query, statement

# Predicates and shapes.
statement("regex_filter", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM {part} WHERE regexp_extract(p_brand, '([0-9]+)', 1) >= '2'")
statement("null_logic", "SELECT p_partkey, nullif(p_size, 1) IN (2, 3) AS listed, nullif(p_size, 1) > 10 OR p_size = 1 AS either, coalesce(nullif(p_size, 1), -1) AS size FROM {part}")
statement("pipe_syntax", "FROM {orders} |> WHERE o_totalprice > 1000 |> AGGREGATE count(*) AS n, min(o_totalprice) AS least GROUP BY o_orderstatus |> WHERE n > 1",
    "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS least FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING count(*) > 1")
statement("values_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM {part}")
# Joins.
statement("right_join", "SELECT n_nationkey, count(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_nationkey")
statement("cross_join", "SELECT r_regionkey, n_nationkey FROM {region} CROSS JOIN {nation}")
statement("theta_join", "SELECT r_regionkey, count(*) AS n FROM {region} JOIN {nation} ON n_regionkey < r_regionkey GROUP BY r_regionkey")
statement("null_safe_join", """SELECT a.k, a.n, b.m FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM {customer} GROUP BY 1) a
    JOIN (SELECT nullif(s_nationkey, 3) AS k, count(*) AS m FROM {supplier} GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
statement("lateral_join", "SELECT c_custkey, t.most FROM {customer}, LATERAL (SELECT max(o_totalprice) AS most FROM {orders} WHERE o_custkey = c_custkey) t")
statement("interval_join", """SELECT a.event_id AS seen, b.event_id AS bought FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS
    WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
statement("hash_join", "SELECT /*+ SHUFFLE_HASH(orders) */ l_orderkey, count(*) AS n, max(o_totalprice) AS most FROM {lineitem} AS lines JOIN {orders} AS orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    "SELECT l_orderkey, count(*) AS n, max(o_totalprice) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
statement("using_join", "SELECT k, n, m FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY 1) JOIN (SELECT s_nationkey AS k, count(*) AS m FROM {supplier} GROUP BY 1) USING (k)")
# Aggregates.
statement("grouping_marks", """SELECT c_mktsegment, c_nationkey, CAST(grouping(c_mktsegment) AS BIGINT) AS g, CAST(grouping_id(c_mktsegment, c_nationkey) AS BIGINT) AS id, count(*) AS n
    FROM {customer} GROUP BY CUBE (c_mktsegment, c_nationkey)""")
statement("group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL")
statement("distinct_sums", "SELECT l_returnflag, sum(DISTINCT l_quantity) AS s, avg(DISTINCT l_quantity) AS a, count(DISTINCT l_suppkey, l_linenumber) AS n FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, sum(DISTINCT l_quantity) AS s, avg(DISTINCT l_quantity) AS a, count(DISTINCT (l_suppkey, l_linenumber)) AS n FROM lineitem GROUP BY l_returnflag")
statement("regression", """SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS base, regr_r2(l_extendedprice, l_quantity) AS r2,
    covar_samp(l_extendedprice, l_quantity) AS cs, covar_pop(l_extendedprice, l_quantity) AS cp, stddev_pop(l_tax) AS sd, var_samp(l_tax) AS v FROM {lineitem} GROUP BY l_returnflag""")
statement("moments", "SELECT event_type, skewness(value) * sqrt(count(value) * (count(value) - 1)) / (count(value) - 2) AS skew, kurtosis(value) AS kurt FROM {events} GROUP BY event_type",
    "SELECT event_type, skewness(value) AS skew, kurtosis_pop(value) AS kurt FROM events GROUP BY event_type")
statement("arg_extremes", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS low FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey")
statement("logic_aggregates", """SELECT c_nationkey, bool_and(c_acctbal > 0) AS every, bool_or(c_acctbal < 0) AS some, bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx, count_if(c_acctbal > 0) AS n
    FROM {customer} GROUP BY c_nationkey""",
    """SELECT c_nationkey, bool_and(c_acctbal > 0) AS every, bool_or(c_acctbal < 0) AS some, bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx, CAST(count_if(c_acctbal > 0) AS BIGINT) AS n
    FROM customer GROUP BY c_nationkey""")
statement("ordered_text", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names, array_join(sort_array(collect_set(left(n_name, 3))), '/') AS parts FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, array_to_string(list_sort(list(DISTINCT left(n_name, 3))), '/') AS parts FROM nation GROUP BY n_regionkey")
# Sketches: estimates differ between engines, so what is compared is their error bound against the exact value.
statement("sketch_distinct", """SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS plain,
    abs(hll_sketch_estimate(hll_sketch_agg(l_partkey)) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS hll,
    abs(theta_sketch_estimate(theta_sketch_agg(l_partkey)) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS theta FROM {lineitem} GROUP BY l_returnflag""",
    "SELECT DISTINCT l_returnflag, true AS plain, true AS hll, true AS theta FROM lineitem")
statement("sketch_quantiles", """SELECT l_returnflag, abs(approx_percentile(l_extendedprice, 0.5) - percentile(l_extendedprice, 0.5)) <= 0.02 * (max(l_extendedprice) - min(l_extendedprice)) AS close,
    abs(kll_sketch_get_quantile_double(kll_sketch_agg_double(l_extendedprice), 0.5D) - percentile(l_extendedprice, 0.5)) <= 0.05 * (max(l_extendedprice) - min(l_extendedprice)) AS kll FROM {lineitem} GROUP BY l_returnflag""",
    "SELECT DISTINCT l_returnflag, true AS close, true AS kll FROM lineitem")
# Merged from partial sketches, as they are kept per day or per file.
statement("sketch_union", """SELECT l_returnflag, abs(hll_sketch_estimate(hll_union_agg(h)) - max(exact)) <= 0.1 * max(exact) AS hll, abs(theta_sketch_estimate(theta_union_agg(t)) - max(exact)) <= 0.1 * max(exact) AS theta,
    abs(kll_sketch_get_quantile_double(kll_merge_agg_double(k), 0.5D) - max(mid)) <= 0.05 * max(span) AS kll
    FROM (SELECT l_returnflag, l_linenumber, hll_sketch_agg(l_partkey) AS h, theta_sketch_agg(l_partkey) AS t, kll_sketch_agg_double(l_extendedprice) AS k FROM {lineitem} GROUP BY ALL)
    JOIN (SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS exact, percentile(l_extendedprice, 0.5) AS mid, max(l_extendedprice) - min(l_extendedprice) AS span FROM {lineitem} GROUP BY l_returnflag) ON flag = l_returnflag
    GROUP BY l_returnflag""",
    "SELECT DISTINCT l_returnflag, true AS hll, true AS theta, true AS kll FROM lineitem")
statement("top_items", "SELECT t.item AS p_brand, t.count AS n FROM (SELECT explode(approx_top_k(p_brand, 100, 1000)) AS t FROM {part})", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
statement("top_items_merged", """SELECT t.item AS event_type, t.count AS n FROM (SELECT explode(approx_top_k_estimate(approx_top_k_combine(a), 10)) AS t FROM
    (SELECT approx_top_k_accumulate(event_type) AS a FROM {events} GROUP BY user_id))""", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
statement("collected", "SELECT o_custkey, array_sort(collect_list(o_orderkey)) AS orders FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, list_sort(list(o_orderkey)) AS orders FROM orders GROUP BY o_custkey")
# Windows.
statement("rank_shares", "SELECT p_partkey, CAST(dense_rank() OVER w AS BIGINT) AS d, percent_rank() OVER w AS p, cume_dist() OVER w AS c FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
statement("frame_values", """SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n FROM {events}
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""")
statement("range_frame", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS s FROM {events}")
statement("share_of_total", "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM {orders}")
statement("top_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {orders}) WHERE n <= 3")
# Order and sets.
statement("offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 100")
statement("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
statement("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}")
statement("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}")


@query("union_by_name", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL BY NAME SELECT s_acctbal AS bal, s_suppkey AS k, s_name AS name FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return buyers.unionByName(sellers, allowMissingColumns=True)


@query("qualify", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) <= 2")
def dearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    order = windows.Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"))
    return windows.qualify(rows, F.rank().over(order) <= 2)


@query("exclude_frame", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS s FROM events")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return windows.excluding(rows, ["user_id"], "event_id", 2, 2, {"s": ("sum", "value")}).select("event_id", "s")


@query("exclude_group", "SELECT p_partkey, sum(p_size) OVER w AS s, max(p_size) OVER w AS m FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN 200 PRECEDING AND 200 FOLLOWING EXCLUDE GROUP)")
def other_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the parts of a brand, less those of the row's own type."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("long").alias("size"))
    return windows.excluding(rows, ["p_brand"], "p_type", 200, 200, {"s": ("sum", "size"), "m": ("max", "size")}, "group", ["p_partkey"]).select("p_partkey", "s", "m")


@query("exclude_ties", "SELECT p_partkey, count(p_size) OVER w AS n, avg(p_size) OVER w AS a FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN 200 PRECEDING AND 200 FOLLOWING EXCLUDE TIES)")
def without_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("long").alias("size"))
    return windows.excluding(rows, ["p_brand"], "p_type", 200, 200, {"n": ("count", "size"), "a": ("avg", "size")}, "ties", ["p_partkey"]).select("p_partkey", "n", "a")


@query("percentiles", "SELECT p_brand, percentile_disc(0.9) WITHIN GROUP (ORDER BY p_retailprice) AS d, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS c, median(p_size) AS m FROM part GROUP BY p_brand")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each by its own passes, joined by the group."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_size")
    found = ranks.percentile(rows, ["p_brand"], "p_retailprice", 0.9, "d", discrete=True)
    for value, share, into in (("p_retailprice", 0.25, "c"), ("p_size", 0.5, "m")):
        found = ranks.joined_by(found, ranks.percentile(rows, ["p_brand"], value, share, into), ["p_brand"])
    return found.select("p_brand", "d", "c", "m")


@query("asof_correlated", """SELECT event_id, (SELECT arg_max(b.value, b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts) AS price
    FROM events a WHERE a.event_type = 'view'""")
def last_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlated form as an as-of join: as a subquery, Spark pairs all view times with all purchases."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return joins.asof_join(events.filter("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "ts", ["user_id"], ["price"]).select("event_id", "price")


@query("asof_any_user", """SELECT v.event_id, p.event_id AS bought FROM (SELECT * FROM events WHERE event_type = 'view') v
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.ts >= p.ts""")
def asof_any_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of anyone before each view: no key, so both sides are dealt by ranges of time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    bought = events.filter("event_type = 'purchase'").select("ts", F.col("event_id").alias("bought"))
    return joins.asof_join(events.filter("event_type = 'view'").select("event_id", "ts"), bought, "ts", [], ["bought"]).select("event_id", "bought")


@query("asof_hot_status", """SELECT o_orderkey, CASE WHEN least(back, ahead) <= INTERVAL 12 HOUR THEN CASE WHEN ahead IS NULL OR back <= ahead THEN b.l_shipdate ELSE f.l_shipdate END END AS shipped
    FROM (SELECT o.*, b.l_shipdate, o.o_orderdate - b.l_shipdate AS back FROM orders o ASOF LEFT JOIN (SELECT DISTINCT l_linestatus, l_shipdate FROM lineitem) b ON o.o_orderstatus = b.l_linestatus AND o.o_orderdate >= b.l_shipdate) b
    JOIN (SELECT o.o_orderkey, f.l_shipdate, f.l_shipdate - o.o_orderdate AS ahead FROM orders o ASOF LEFT JOIN (SELECT DISTINCT l_linestatus, l_shipdate FROM lineitem) f ON o.o_orderstatus = f.l_linestatus AND o.o_orderdate <= f.l_shipdate) f
    USING (o_orderkey)""")
def asof_hot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipping day of the same status nearest to each order: three keys for all rows, so by ranges of status and time."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("day")).distinct().withColumn("shipped", F.col("day"))
    return joins.asof_join(orders, lines, "day", ["status"], ["shipped"], "nearest", F.expr("INTERVAL 12 HOURS"), ranges=0).select("o_orderkey", "shipped")


@query("running_total", """SELECT o_orderkey, row_number() OVER w AS n, (sum(cents) OVER w)::BIGINT AS s, max(cents) OVER w AS m, avg(cents) OVER w AS a
    FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders) WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all orders in one sequence, by prefix sums of ranges."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    made = {"n": ("row_number",), "s": ("sum", "cents"), "m": ("max", "cents"), "a": ("avg", "cents")}
    return ordered.running(rows, [], ["o_orderdate", "o_orderkey"], made).select("o_orderkey", F.col("n").cast("long").alias("n"), "s", "m", "a")


@query("global_ranks", """SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, percent_rank() OVER w AS p, cume_dist() OVER w AS c, ntile(7) OVER (ORDER BY p_retailprice DESC, p_partkey) AS t FROM part
    WINDOW w AS (ORDER BY p_retailprice DESC)""")
def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in one order of all parts, with ties."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    places = ordered.running(rows, [], ["-p_retailprice"], {"r": ("rank",), "d": ("dense_rank",), "p": ("percent_rank",), "c": ("cume_dist",)})
    groups = ordered.running(rows, [], ["-p_retailprice", "p_partkey"], {"t": ("ntile", 7)}).select(F.col("p_partkey").alias("k"), "t")
    return places.join(groups, F.col("p_partkey") == F.col("k")).select("p_partkey", *[F.col(c).cast("long").alias(c) for c in ("r", "d")], "p", "c", F.col("t").cast("long").alias("t"))


@query("hot_key_totals", """SELECT DISTINCT l_returnflag, l_shipdate, count(*) OVER w AS n, sum(l_quantity) OVER w AS q FROM lineitem
    WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate RANGE UNBOUNDED PRECEDING)""")
def hot_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys hold all lines; each day's rows are summed first, which RANGE frames allow."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.count("*").alias("c"), F.sum("l_quantity").alias("v"))
    made = ordered.running(rows, ["l_returnflag"], ["l_shipdate"], {"n": ("sum", "c"), "q": ("sum", "v")}, peers=True)
    return made.select("l_returnflag", "l_shipdate", "n", "q")


@query("windowed_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS n FROM events")
def kinds_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted per key and joined back: no task holds the set of a whole partition."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kinds = rows.groupBy(F.col("user_id").alias("u")).agg(F.count_distinct("event_type").alias("n"))
    return rows.join(kinds, F.col("user_id").eqNullSafe(F.col("u"))).select("event_id", "n")


@query("sample", "SELECT true AS near, true AS repeated, true AS inside")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the lines: their number is within six standard deviations, the same rows come at each run, all of the table."""
    rows = table(spark, sf_dir, "lineitem")
    some = lambda name: rows.sample(fraction=0.1, seed=7).agg(F.count("*").alias(name), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias(f"{name}_hash"))
    outside = rows.sample(fraction=0.1, seed=7).exceptAll(rows).agg(F.count("*").alias("outside"))
    counted = some("a").crossJoin(some("b")).crossJoin(outside).crossJoin(rows.agg(F.count("*").alias("all")))  # a row each
    bound = F.abs(F.col("a") - 0.1 * F.col("all")) <= 6 * F.sqrt(0.09 * F.col("all"))
    return counted.select(bound.alias("near"), ((F.col("a") == F.col("b")) & (F.col("a_hash") == F.col("b_hash"))).alias("repeated"), (F.col("outside") == 0).alias("inside"))
