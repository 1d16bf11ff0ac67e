"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of a prime number of slots, from two hashes of its name.
Shards take turns claiming the next free slot of their order until the table is full. A key's hash
modulo the prime gives its slot, and the table, whose size is the prime and nothing else, is
broadcast: placement takes constant time, and few keys move when a shard is added or lost.

Cases: a null key is placed as the empty string. Equal keys share a shard. Empty tables give empty
results. Columns of the table are kept; the added ones replace any of the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime; over a hundred times the shards keeps their shares within about a percent.
SLOTS = 10_007
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shard names must be distinct, at least one and at most as many as slots")
    at = [_number(f"offset:{n}") % slots for n in names]
    step = [_number(f"skip:{n}") % (slots - 1) + 1 for n in names]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def shard_names(shards: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row."""
    table = lookup_table(names or shard_names(), slots)
    lookup = df.sparkSession.createDataFrame(list(enumerate(table)), "slot int, shard int")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(lookup), "slot", "left")


def write_shards(df: DataFrame, key: str, path: str, names: list[str] | None = None) -> None:
    """One folder a shard. A shard's rows are dealt over several tasks, however many there are."""
    placed = place(df, key, names)
    placed.withColumn("__deal", F.pmod(F.xxhash64(key), F.lit(8))).repartition("shard", "__deal").drop("__deal").write.partitionBy("shard").parquet(path)
