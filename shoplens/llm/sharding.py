"""Placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The shards take
turns: each claims the first slot of its order that is still free, until the table is full. Shards so get
nearly equal numbers of slots, and when a shard is added or removed few slots change their owner. A
document goes to the owner of its key's slot, found by one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, and so a fixed bound of what is broadcast (about 1 MB).
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{text}".encode()).digest()[:8], "big")


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step: the shard prefers slots offset, offset + step, offset + 2 step, ... modulo the size.

    The size is prime, so every step from 1 to size - 1 visits each slot once.
    """
    return _number(shard, "offset") % size, _number(shard, "step") % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, turns: Sequence[int] | None = None) -> list[int]:
    """The owner (position in shards) of every slot. turns: how many slots a shard claims per round, 1 by default."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and one at least")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be prime and not below the number of shards")
    turns = list(turns or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or max(turns) == 0:
        raise ValueError("turns needs one number of at least 0 per shard, not all 0")
    at, steps = map(list, zip(*(preference(s, size) for s in shards)))
    owner, free = [-1] * size, size
    while free:
        for k, claims in enumerate(turns):
            for _ in range(min(claims, free)):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + steps[k]) % size
                owner[at[k]], free = k, free - 1
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE,
                 turns: Sequence[int] | None = None) -> DataFrame:
    """slot, shard (its number), shard_name: one row per slot."""
    rows = [(slot, k, shards[k]) for slot, k in enumerate(fill_table(shards, size, turns))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def slot_of(*keys: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: Sequence[str], key_cols: Sequence[str] = ("doc_id",), size: int = TABLE_SIZE,
          turns: Sequence[int] | None = None) -> DataFrame:
    """The documents with slot, shard and shard_name (columns of these names are replaced).

    A null key has a fixed slot of its own, repeated keys share their slot, an empty table stays empty.
    """
    found = docs.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(*map(F.col, key_cols), size=size))
    return found.join(F.broadcast(lookup_table(docs.sparkSession, shards, size, turns)), "slot").select(
        *[c for c in found.columns if c != "slot"], "slot", "shard", "shard_name")
