"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized
table; shards take turns claiming their next free slot until the table is full.
A document's key hashes to a slot, and the broadcast table (its size is a
parameter, not a matter of the data) gives the shard in constant time.  Adding
or losing a shard moves little more than that shard's share.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TABLE = 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's walk; the step never shares a divisor
    with a prime size, so the walk meets every slot once."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill_table(shards: list[str], size: int) -> list[int]:
    """Index of the shard that owns each slot."""
    if not _is_prime(size) or not 0 < len(set(shards)) == len(shards) <= size <= MAX_TABLE:
        raise ValueError("need distinct shards and a prime table size, not below their number")
    owner, walks = [-1] * size, [[*preference(s, size)] for s in shards]
    for turn in range(size):
        at, step = walks[shard := turn % len(shards)]
        while owner[at] >= 0:
            at = (at + step) % size
        owner[at], walks[shard][0] = shard, (at + step) % size
    return owner


def lookup(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """The table as rows ``slot``, ``shard``; made from one constant string."""
    owner = fill_table(shards, size)
    width = max(1, len(f"{len(shards) - 1:x}"))
    packed = F.lit("".join(f"{s:0{width}x}" for s in owner))
    code = F.substr(packed, (F.col("id") * width + 1).cast("int"), F.lit(width))
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(size).select(F.col("id").alias("slot"), F.get(names, F.conv(code, 16, 10).cast("int")).alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % F.lit(size)


def place(docs: DataFrame, shards: list[str], size: int = 65_537, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """All rows and columns of ``docs`` with their ``slot`` and ``shard``
    (columns of those names in the input are replaced).

    The key is doc_id as text; without a doc_id it is the text, so that such
    rows spread too, and without both it is one constant.  Rows with one key
    share a shard.  An empty table stays empty.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    rest = [c for c in docs.columns if c not in (slot, shard)]
    table = lookup(docs.sparkSession, shards, size).withColumnsRenamed({"slot": slot, "shard": shard})
    return docs.select(*rest, slot_of(key, size).alias(slot)).join(F.broadcast(table), slot).select(*rest, slot, shard)


def write_shards(placed: DataFrame, path: str, parts: int = 8, shard: str = "shard") -> None:
    """One folder per shard; a shard is written by up to ``parts`` tasks, so a
    large one isn't left to a single task."""
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    placed.repartition(F.col(shard), spread).write.mode("overwrite").partitionBy(shard).parquet(path)
