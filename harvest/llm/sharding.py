"""Placement of rows on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own: ``offset + i * skip``
modulo the size. The shards take turns; on its turn a shard claims the first slot of its order that
is still free. All shards end with the same number of slots (give or take one), and when a shard
leaves, few slots of the others change. A row's key is hashed to a slot; the table says its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvest.llm.common import free_name

TABLE_SIZE = 65_537         # prime; a hundred slots or more for each of up to 650 shards
LARGEST_TABLE = 4_000_000   # the table is sent to every task: at most this many rows of 12 bytes


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def filled_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the number of its shard in ``shards``."""
    if not _is_prime(size) or size > LARGEST_TABLE:
        raise ValueError(f"the table size must be a prime up to {LARGEST_TABLE}")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, at least one and at most one for each slot")
    digests = [hashlib.sha256(str(s).encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "little") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "little") % (size - 1) + 1 for d in digests]
    table, left = [-1] * size, size
    while True:
        for shard, step in enumerate(skip):
            slot = place[shard]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot], place[shard] = shard, (slot + step) % size
            left -= 1
            if not left:
                return table


def slot_of(keys: Sequence[str], columns: Sequence[str], size: int) -> Column:
    """Slot by the hash of the keys; rows whose keys are all null are spread by their other columns."""
    rest = [F.col(f"`{c}`") for c in columns] or [F.lit(0)]
    own = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    known = F.coalesce(*[F.col(f"`{k}`").cast("string") for k in keys]).isNotNull()
    return F.pmod(F.when(known, own).otherwise(F.xxhash64(*rest)), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows ``(_slot, _shard)``."""
    table = filled_table(shards, size)
    return spark.createDataFrame(pa.table({"_slot": pa.array(range(size), pa.int32()),
                                           "_shard": pa.array([str(shards[i]) for i in table])}))


def place(df: DataFrame, shards: Sequence[str], keys: Sequence[str] = ("doc_id",), size: int = TABLE_SIZE,
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of every row; columns of these names are replaced.

    One narrow pass: the table is broadcast (its size is fixed by ``size``), nothing is shuffled, and
    a source or text that holds a third of all rows is spread as the keys are. Rows with the same keys
    share a shard; null keys: see ``slot_of``. An empty table gives an empty one.
    """
    rows = df.withColumn(slot, slot_of(keys, [c for c, kind in df.dtypes if "map" not in kind], size))
    at = free_name([*df.columns, slot, shard])
    found = free_name([*df.columns, slot, shard, at])
    table = F.broadcast(table_frame(df.sparkSession, shards, size).select(F.col("_slot").alias(at), F.col("_shard").alias(found)))
    return rows.join(table, rows[slot] == table[at], "left").drop(at).withColumn(shard, F.col(found)).drop(found)


def write_shards(df: DataFrame, path: str, shards: Sequence[str], keys: Sequence[str] = ("doc_id",),
                 size: int = TABLE_SIZE) -> None:
    """Write one folder per shard. The rebalance hint lets Spark cut large shards over several files."""
    placed = place(df, shards, keys, size)
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
