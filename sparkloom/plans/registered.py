"""Where queries and their oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES, table
from ..sql import guarded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query and its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """A query that is one SQL statement; tables stand in braces. The oracle is the same statement unless given."""
    sql = guarded(sql)
    used = [t for t in TABLES if "{" + t + "}" in sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    ORACLES[name] = (oracle or sql).replace("{", "").replace("}", "")
