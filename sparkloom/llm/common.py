"""What the operators of this subpackage share: scratch tables in the shared folder and small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from ..names import unused  # noqa: F401  (for the operators)
from ..session import scratch

SALTS = 16  # over which the rows of a hot key are dealt
BROADCAST_ROWS = 300_000  # of some numbers each
BROADCAST_BYTES = 32_000_000

#: ASCII white space, the only separators of words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by save() which nothing lazy still reads."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted(member: str) -> Column:
    return F.pmod(F.xxhash64(member, F.lit(13)), F.lit(SALTS)).cast("int")


def salt_mask(member: str) -> Column:
    """An aggregate: the salts that a group's rows have, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), salted(member)))


def salts_of(mask: str) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda z: F.col(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1), z)) != 0)


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side that grows with the input, to join with by a shuffle: Spark would gather it in the driver for a broadcast as long as its
    compressed files or shuffle blocks are below a threshold, though the driver then holds far more than these."""
    return side.hint("merge")


def held(side: DataFrame) -> Column:
    """About the bytes of a row in a broadcast table, its place in the map included."""
    sizes = []
    for field in side.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, ArrayType):
            sizes.append(F.coalesce(F.size(c), F.lit(0)) * 8 + 24)
        elif isinstance(kind, BinaryType | StringType):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)) + 8)
        else:
            sizes.append(F.lit(8 * (2 + len(kind) if isinstance(kind, StructType) else 1)))
    return sum(sizes, F.lit(64)).cast("long")


def attach(rows: DataFrame, side: DataFrame, on: list[str], member: str, how: str = "inner") -> DataFrame:
    """rows joined with side, a saved table with a row at most for each value of the columns `on`, of which rows may have very many.

    Broadcast up to BROADCAST_ROWS and BROADCAST_BYTES, else dealt by a salt of the member."""
    own = {c: f"__{c}" for c in on}
    other = side.withColumnsRenamed(own)
    match = [F.col(c) == F.col(name) for c, name in own.items()]
    found = side.agg(F.count("*").alias("n"), F.coalesce(F.sum(held(side)), F.lit(0)).alias("bytes")).first()
    if found["n"] <= BROADCAST_ROWS and found["bytes"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), match, how).drop(*own.values())
    other = other.withColumn("__z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(by_shuffle(other), [*match, salted(member) == F.col("__z")], how).drop("__z", *own.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where lambdas in body refer to it for each element."""
    return F.transform(F.array(value), body)[0]


BLOCK = 256  # elements over which a running value is carried by copying


def scanned(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running join (an associative one, such as a sum) of an array of ints of zero or more, each element's own included.

    An array is cut into blocks, as appending to one copies it: the joins of whole blocks are carried first, then each block's
    own are appended to what came before it.
    """
    none = F.array().cast("array<int>")
    fold = lambda x, start, keep: F.aggregate(x, F.struct(start.alias("at"), none.alias("out")), keep, lambda acc: acc["out"])
    before = lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    after = lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], v))).alias("out"))

    def carried(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: join(acc, v)))
        return F.flatten(F.zip_with(blocks, fold(totals, F.lit(0), before), lambda x, start: fold(x, start, after)))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(cut(v), carried)))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; -1 where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))
