"""Tables bucketed by their join keys: joins and aggregates by these read them without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import scratch


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """df written as a table of so many buckets by the hash of the keys, each a file that is sorted by them, and read back.

    Rows are dealt by the same hash before they are written, so a bucket comes from one task; a key that holds many rows is one
    bucket's, as in any exchange by it. Tables that are to be joined need equal numbers of buckets, and keys of equal types. The
    table is external: its files are in the shared folder, and stay there when the session's catalogue is gone.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch(df.sparkSession, f"bucketed-{name}")).saveAsTable(table)
    return df.sparkSession.table(table)
