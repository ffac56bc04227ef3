"""Sharding by a permutation-filled lookup table. DataFrame functions only for placement.

Each shard has its own permutation of the slots of a prime-sized table, given by an offset and a step from its name's hash.
Shards take turns; at its turn a shard claims the first slot of its permutation that is still free, until all are taken.
Every shard so gets an almost equal number of slots, and few slots change hands when a shard joins or leaves. The table has
a fixed size, whatever the data, so it is broadcast; a row is placed by one hash and one lookup, without a shuffle.

Defined results: a null key is hashed as the empty string. Equal keys share a slot, repeated rows alike. An empty table gives an
empty result. The length of other columns' texts does not matter. `place` passes all columns through, whatever their names; where
one is named like an added column, the added one has an underscore behind its name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

SLOTS = 8191  # prime, over 100 times the shards
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def digest(name: str) -> int:
    """The first 15 hex digits of the MD5, as a number: the same in Python, Spark and other engines' SQL."""
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The owner (place in `shards`) of each slot."""
    if not shards or len(set(shards)) != len(shards) or slots <= len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct and fewer than the slots, whose number must be prime")
    at = [digest(f"offset/{s}") % slots for s in shards]
    step = [digest(f"step/{s}") % (slots - 1) + 1 for s in shards]
    owner, taken = [-1] * slots, 0
    while taken < slots:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            taken += 1
            if taken == slots:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its MD5's first 15 hex digits modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, into: str = "shard", slot: str = "slot") -> DataFrame:
    """rows with their slot and shard."""
    spark = rows.sparkSession
    slot, into, at, filled_slot, owner = unused([slot, into, "__at", "__slot", "__owner"], rows.columns)
    owners = F.array(*[F.lit(x) for x in shards])
    numbers = F.lit(",".join(map(str, fill(shards, slots))))  # one literal, where an array would be one for each slot
    filled = spark.range(1).select(F.posexplode(F.split(numbers, ",").cast("array<int>")).alias("slot", "owner"))
    lookup = filled.select(F.col("slot").cast("long").alias(filled_slot), F.get(owners, F.col("owner")).alias(owner))
    keyed = rows.withColumn(at, slot_of(F.col(f"`{key}`"), slots))
    joined = keyed.join(F.broadcast(lookup), keyed[at] == lookup[filled_slot])
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(at).alias(slot), F.col(owner).alias(into))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id")
