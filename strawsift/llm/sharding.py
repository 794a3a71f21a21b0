"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, and the shards take turns, each claiming the
next free slot of its own order, until the table is full. A key's slot is its hash modulo the size, so placing a row is one
look-up in a table of fixed size, which is broadcast. When a shard goes, nearly all slots of the others stay as they are.

The table depends on the shards and its size alone, never on the data; it is filled on the driver. Rows are placed by
DataFrame functions only. A null key counts as the empty string; equal keys share a shard (repeated rows too); an empty
table of rows gives an empty result; other columns, whatever their names, are carried along. A hot key would fill one
shard, so shard by a key that is unique for each row, or give ``write_shards`` several ``files`` a shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537  # prime, over 1000 slots for each of 64 shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE, turns: dict[str, int] | None = None) -> list[int]:
    """The index into ``shards`` of each slot. ``turns``: how many slots a shard claims in a round (1)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the size must be a prime that is no less than the number of shards")
    rounds = [(turns or {}).get(s, 1) for s in shards]
    if min(rounds) < 0 or not any(rounds):
        raise ValueError("turns must not be negative, nor all zero")
    at = [_number(s, "offset") % size for s in shards]
    step = [1 + _number(s, "step") % (size - 1) for s in shards]
    table, free = [-1] * size, size
    while free:
        for shard, claims in enumerate(rounds):
            for _ in range(min(claims, free)):
                slot = at[shard]
                while table[slot] >= 0:
                    slot = (slot + step[shard]) % size
                table[slot] = shard
                at[shard] = (slot + step[shard]) % size
                free -= 1
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The first 60 bits of the key's MD5, modulo the size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)).cast("int")


def slots(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) rows of a look-up table; as many as it has slots."""
    filled = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(filled).alias("_slot", "_shard")).select("_slot", F.col("_shard").cast("int"))


def place(df: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, size: int = SIZE, turns: dict[str, int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` (a number) of each row, in place of any of these names; no row is shuffled."""
    found = F.broadcast(slots(df.sparkSession, lookup_table(shards, size, turns)))
    kept = [df[c] for c in df.columns if c not in (slot, shard)]
    rows = df.select(F.struct(*kept).alias("_row"), slot_of(key, size).alias("_at")) if kept else df.select(slot_of(key, size).alias("_at"))
    rows = rows.join(found, F.col("_at") == F.col("_slot"))
    return rows.select(*(["_row.*"] if kept else []), F.col("_at").alias(slot), F.col("_shard").alias(shard))


def write_shards(placed: DataFrame, path: str, files: int = 4, shard: str = "shard", n_shards: int = len(SHARDS)) -> None:
    """Write one folder a shard, dealing each shard's rows over ``files`` tasks."""
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(files))
    placed.repartition(n_shards * files, shard, salt).write.partitionBy(shard).parquet(path)
