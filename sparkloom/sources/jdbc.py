"""Tables of other databases through JDBC."""

from __future__ import annotations

import os
import zipfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch

EMBEDDED = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def read(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A scan; with a numeric key it is read in so many parts at once, whose ranges cover all rows: those outside the bounds go to
    the first and the last part. Filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write(rows: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """A sink; each task writes its rows in a transaction of its own, so a repeated task may write rows twice without a key."""
    rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def sealed(rows: DataFrame, name: str) -> str:
    """The URL of a new database, with rows as its table, that every executor can read at once (options: EMBEDDED).

    The embedded database that comes with Spark lives in one JVM: tasks of several executors can't write to one. So Spark makes the
    table, tasks write its rows as files to the shared folder, the database loads these, and is sealed as an archive, which any number
    of JVMs may open to read. The shared folder has to be a path that executors can open as files are. Columns of numbers and strings."""
    spark, root = rows.sparkSession, scratch(rows.sparkSession, f"database-{name}")
    if (parsed := urlparse(root)).scheme not in ("", "file"):
        raise ValueError(f"an embedded database needs a shared folder of plain files, not {root}")
    folder = parsed.path
    rows.write.csv(f"{root}/rows", escape='"', emptyValue='""')
    url, sql = f"jdbc:derby:{folder}/loom", spark._jvm.java.sql.DriverManager
    write(rows.limit(0), f"{url};create=true", name, **EMBEDDED)
    link = sql.getConnection(url)
    try:
        for part in sorted(f.path for f in os.scandir(f"{folder}/rows") if f.name.startswith("part-")):
            load = link.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
            load.setString(1, name.upper())
            load.setString(2, part)
            load.execute()
            load.close()
    finally:
        link.close()
    try:
        sql.getConnection(f"{url};shutdown=true")
    except Exception as e:  # it tells so by an error, 08006
        if "08006" not in str(e) and "shutdown" not in str(e):
            raise
    with zipfile.ZipFile(f"{folder}/loom.jar", "w", zipfile.ZIP_STORED) as jar:
        for at, _, files in os.walk(f"{folder}/loom"):
            for f in files:
                if f not in ("db.lck", "dbex.lck"):
                    jar.write(path := os.path.join(at, f), os.path.relpath(path, folder))
    return f"jdbc:derby:jar:({folder}/loom.jar)loom"
