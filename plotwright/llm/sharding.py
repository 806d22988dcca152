"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset
and a stride from hashes of its name); shards take turns, each claiming its next free
slot, until the table is full. A row's key hashes to a slot, the broadcast table gives
the shard: constant time, even loads, and few moves when a shard comes or goes.

The table has ``slots`` rows whatever the data, so its broadcast is bounded. Rows of a
key with more than ``hot_rows`` rows are spread by a hash of the other given columns
(``spread``), so that no shard must hold a third of all rows; without ``spread`` all
rows of a key stay together.

Defined results: a null key is a key like any other; an empty table gives an empty
result; repeated rows go to the same shard. Other columns pass through; those called
shard_slot or shard give way to the new ones (but may be keys).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import others


def number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The shard's index for each slot. Names in any order give the same table (of names)."""
    if not shards or len({*shards}) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime, not below the number of shards")
    order = sorted(range(len(shards)), key=lambda k: shards[k])
    at = {k: number(shards[k], "offset") % slots for k in order}
    stride = {k: number(shards[k], "stride") % (slots - 1) + 1 if slots > 1 else 1 for k in order}
    table, left = [-1] * slots, slots
    while True:
        for k in order:
            while table[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = 65_537, spread: Sequence[str] = (), hot_rows: int = 1_000_000) -> DataFrame:
    """``df`` with shard_slot and shard."""
    hashed = lambda names, *first: F.xxhash64(*first, *[F.col(f"`{c}`").cast("string") for c in names])
    spark = df.sparkSession
    table = spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill(shards, slots))], "slot int, shard string")
    keyed = df.select(hashed(keys).alias("key"), *([hashed(spread, hashed(keys)).alias("other")] if spread else []), F.struct(F.lit(0).alias("_"), *others(df, "shard_slot", "shard")).alias("row"))
    if spread:
        hot = keyed.groupBy("key").count().where(F.col("count") > hot_rows).select("key", F.lit(True).alias("hot"))
        keyed = keyed.join(hot, "key", "left").select(F.when(F.col("hot"), F.col("other")).otherwise(F.col("key")).alias("key"), "row")
    placed = keyed.select(F.pmod("key", F.lit(slots)).cast("int").alias("slot"), "row").join(F.broadcast(table), "slot")
    own = [F.col(f"row.`{c}`") for c in keyed.schema["row"].dataType.names[1:]]
    return placed.select(*own, F.col("slot").alias("shard_slot"), "shard")


def write(df: DataFrame, path: str, keys: Sequence[str], shards: Sequence[str], **options) -> None:
    """Parquet partitioned by shard; rows of a shard are written by several tasks, so no task holds a whole shard."""
    place(df, keys, shards, **options).drop("shard_slot").write.partitionBy("shard").parquet(path)
