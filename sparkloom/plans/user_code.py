"""Queries of user-defined functions, and of formats written and read back."""

from __future__ import annotations


import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import user
from ..session import scratch, table
from ..sources import files, jdbc, segments
from .registered import ORACLES, QUERIES, query


@query("udf_scalar", "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = user.scalar("net", lambda price, discount: price * (1 - discount), "double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", net("l_extendedprice", "l_discount").alias("net"))


@query("udf_aggregate", """SELECT p_brand, CASE WHEN count(*) > 2 THEN (sum(p_retailprice) - min(p_retailprice) - max(p_retailprice)) / (count(*) - 2) END AS mean FROM part GROUP BY p_brand""")
def aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(user.trimmed_mean("p_retailprice").alias("mean"))


@query("udf_row", "SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS name FROM part")
def row_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = user.row_by_row(lambda name: None if name is None else " ".join(reversed(name.split(" "))), "string")
    return table(spark, sf_dir, "part").select("p_partkey", turned("p_name").alias("name"))


@query("udf_window", """SELECT p_partkey, CASE WHEN count(*) OVER w > 2 THEN (sum(p_retailprice) OVER w - min(p_retailprice) OVER w - max(p_retailprice) OVER w) / (count(*) OVER w - 2) END AS mean
    FROM part WINDOW w AS (PARTITION BY p_brand)""")
def over_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", user.trimmed_mean("p_retailprice").over(Window.partitionBy("p_brand")).alias("mean"))


@query("apply_arrow", "SELECT p_brand, max(p_retailprice) - min(p_retailprice) AS spread FROM part GROUP BY p_brand")
def arrow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user.spread(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query("sql_table_function", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS part, CAST(generate_subscripts(string_split(n_name, '_'), 1) - 1 AS INT) AS place FROM nation")
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION name_bits(name STRING) RETURNS TABLE (place INT, part STRING) RETURN SELECT pos, col FROM posexplode(split(name, '_'))")
    return spark.sql("SELECT n_nationkey, bits.part, bits.place FROM {nation}, LATERAL name_bits(n_name) bits", nation=table(spark, sf_dir, "nation"))


@query("udf_arrow", "SELECT p_partkey, CAST(octet_length(encode(p_name)) AS BIGINT) AS n FROM part")
def arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", user.text_bytes("p_name").alias("n"))


@query("udf_table", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS part, CAST(generate_subscripts(string_split(n_name, '_'), 1) - 1 AS INT) AS place FROM nation")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("name_parts", user.Parts)
    return spark.sql("SELECT n_nationkey, part, place FROM {nation}, LATERAL name_parts(n_name, '_')", nation=table(spark, sf_dir, "nation"))


@query("sql_function", "SELECT p_partkey, p_retailprice * 1.2::DOUBLE AS gross FROM part")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gross_price(x DOUBLE) RETURNS DOUBLE RETURN x * 1.2D")
    return spark.sql("SELECT p_partkey, gross_price(p_retailprice) AS gross FROM {part}", part=table(spark, sf_dir, "part"))


@query("apply_grouped", "SELECT p_partkey, p_brand, p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand) AS p_retailprice FROM part")
def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user.centred(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice")


@query("map_batches", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return user.batch_map(rows, lambda b: pa.RecordBatch.from_arrays([b.filter(pc.greater(b.column(1), 0)).column(0)], ["c_custkey"]), "c_custkey long")


@query("apply_cogrouped", """SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) b ON a.k = b.k""")
def cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))

    def sizes(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [(a if len(a) else b)["k"].iloc[0]], "n": [len(a)], "m": [len(b)]})

    return user.side_by_side(buyers, sellers, "k", sizes, "k int, n long, m long")


def round_trip(kind: str, name: str, options: dict[str, str]) -> None:
    """A query that writes a table in a format and gives what is read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, path = table(spark, sf_dir, name), scratch(spark, f"{kind}-{name}")
        files.write(rows, kind, path, **options)
        return files.read(spark, kind, path, rows.schema, **options)

    QUERIES[f"format_{kind}"] = run
    ORACLES[f"format_{kind}"] = f"SELECT * FROM {name}"


round_trip("parquet", "orders", {"compression": "zstd"})
round_trip("orc", "orders", {})
round_trip("json", "supplier", {})
round_trip("csv", "supplier", {"header": "true"})
round_trip("xml", "supplier", {"rowTag": "row"})


@query("format_text", "SELECT n_name AS value FROM nation")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text-nation")
    files.write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "text", path)
    return files.read(spark, "text", path)


@query("format_binary", "SELECT n_name AS value FROM nation")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read whole, as bytes, and cut into lines."""
    path = scratch(spark, "binary-nation")
    files.write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "text", path)
    content = F.decode("content", "UTF-8")
    return files.read(spark, "binaryFile", f"{path}/*.txt").select(F.explode(F.array_remove(F.split(content, "\n"), "")).alias("value"))


@query("source_python", "SELECT event_id, event_type, value FROM events WHERE event_id >= 300 AND event_type = 'purchase' AND value > 10")
def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events written through the source in two commits, and read with filters that it applies itself, where they aren't on doubles."""
    segments.register(spark)
    path = scratch(spark, "segments")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for part in (rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'")):
        part.write.format("segments").mode("append").save(path)
    return spark.read.format("segments").option("filters", "true").load(path).filter("event_id >= 300 AND event_type = 'purchase' AND value > 10")


@query("source_python_stream", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def python_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer through a stream from the source to the source, in two runs of one checkpoint."""
    segments.register(spark)
    first, second, place = (scratch(spark, f"segments-{n}") for n in ("in", "out", "checkpoint"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    for part in (rows.filter("c_nationkey < 9"), rows.filter("c_nationkey >= 9")):
        part.write.format("segments").mode("append").save(first)
        stream = spark.readStream.format("segments").load(first)
        stream.writeStream.format("segments").option("path", second).option("stream", "copy").option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("segments").load(second)


@query("source_jdbc", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey > 1")
def jdbc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the database that comes with Spark, sealed so that every executor reads its parts of the table."""
    url = jdbc.sealed(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "nation")
    return jdbc.read(spark, url, "nation", "n_nationkey", (0, 25), 3, **jdbc.EMBEDDED).filter("n_regionkey > 1").toDF("n_nationkey", "n_regionkey")
