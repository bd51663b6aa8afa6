"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose
size is prime: ``(offset + turn * skip) mod slots`` visits each slot once. The
shards take turns, each claiming its first free slot, until the table is full.
A row's key is hashed to a slot and the slot names the shard, so placement is
one lookup. Shards get equal numbers of slots (to within one), and when a shard comes or
goes nearly all other slots keep their owner.

The table has ``slots`` entries whatever the data; this is the bound of its broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and skip of a shard, from the MD5 of its name."""
    code = hashlib.md5(shard.encode()).hexdigest()
    return int(code[:15], 16) % slots, int(code[15:30], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Place in ``shards`` of the owner of every slot."""
    if not is_prime(slots):
        raise ValueError(f"the number of slots must be prime, not {slots}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be named, distinct and no more than the slots")
    owner = np.full(slots, -1, np.int64)
    start = [preference(s, slots) for s in shards]
    turn = [0] * len(shards)
    claimed = 0
    while claimed < slots:
        for i, (offset, skip) in enumerate(start):
            slot = (offset + turn[i] * skip) % slots
            while owner[slot] >= 0:
                turn[i] += 1
                slot = (offset + turn[i] * skip) % slots
            owner[slot] = i
            turn[i] += 1
            claimed += 1
            if claimed == slots:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    owner = lookup_table(shards, slots)
    return spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner.tolist())], "slot int, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text form; a null key counts as the empty text."""
    code = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(code, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with two more columns, the slot and the shard of every row's key.

    Nothing is shuffled: the table is broadcast (``slots`` rows at most, by
    its parameter). Equal keys go to one shard; a null key goes to the
    shard of the empty text. Columns of ``df`` named like the new ones are replaced.
    """
    table = table_frame(df.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    kept = df.drop(slot, shard).withColumn("__at", slot_of(F.col(key), slots))
    return kept.join(F.broadcast(table), F.col("__at") == F.col("__slot"), "left").drop("__slot") \
        .withColumnsRenamed({"__at": slot, "__shard": shard})


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]
