"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an
offset and a step from its name).  Shards take turns and claim the next free
slot of their permutation, until the table is full.  A key's place is one look
into the table; adding or losing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537  # prime, and far over 100 times the shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For every slot the index of its shard; each shard's share differs by one slot at most."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most one per slot")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    start = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    turn, out, free = [0] * len(shards), [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while True:
                slot = (start[i] + turn[i] * step[i]) % slots
                turn[i] += 1
                if out[slot] < 0:
                    break
            out[slot] = i
            free -= 1
            if not free:
                return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the md5 of its text; a null key counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(spark: SparkSession, rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard.

    The table has as many rows as slots, a parameter, so it is broadcast; rows
    are not moved.  Equal keys, nulls among them, share a shard; columns of rows
    named slot or shard are replaced.
    """
    owners = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))]
    looked = spark.createDataFrame(owners, "slot int, shard string")
    kept = rows.drop(*({"slot", "shard"} - {key})) if key not in ("slot", "shard") else rows.withColumnRenamed(key, "_key").drop("slot", "shard")
    of = key if key not in ("slot", "shard") else "_key"
    return kept.withColumn("slot", slot_of(F.col(of), slots)).join(F.broadcast(looked), "slot").select(*kept.columns, "slot", "shard")
