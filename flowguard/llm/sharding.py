"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size. The shards take turns, each claiming the first free slot of its order,
until the table is full. A row's key is hashed to a slot. Shares differ by a
slot at most, and a shard that goes leaves most other rows where they are.
"""

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _hash(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """The shard of every slot."""
    shards = list(dict.fromkeys(shards))
    if not 0 < len(shards) <= slots:
        raise ValueError(f"{len(shards)} shards do not fit {slots} slots")
    if any(slots % n == 0 for n in range(2, int(slots ** 0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    offset = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    tried = [0] * len(shards)
    table: list[str | None] = [None] * slots
    filled = 0
    while True:
        for i, shard in enumerate(shards):
            slot = (offset[i] + tried[i] * skip[i]) % slots
            while table[slot] is not None:
                tried[i] += 1
                slot = (offset[i] + tried[i] * skip[i]) % slots
            table[slot] = shard
            tried[i] += 1
            filled += 1
            if filled == slots:
                return table


def slot_of(key, slots: int = SLOTS):
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table size; NULL counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, shards: Sequence[str], slots: int = SLOTS, key_col: str = "doc_id") -> DataFrame:
    """The slot and shard of every row: (``key_col``, slot, shard).

    The lookup table has ``slots`` entries, whatever the input, and is
    broadcast. Rows of one key go to one shard; a NULL key is placed like the
    empty text. Other columns are not read.
    """
    table = _table(rows.sparkSession, shards, slots)
    return rows.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("slot")) \
        .join(F.broadcast(table), "slot").select(key_col, "slot", "shard")


def write_shards(rows: DataFrame, path: str, shards: Sequence[str], slots: int = SLOTS, key_col: str = "doc_id",
                 files: int = 1) -> None:
    """Write all rows and columns into a folder ``shard=...`` per shard, each of up to ``files`` files.

    A column named ``shard`` in ``rows`` is refused with a ValueError.
    """
    if "shard" in rows.columns:
        raise ValueError("the table has a column 'shard' already")
    table = _table(rows.sparkSession, shards, slots)
    placed = rows.withColumn("_flowguard_slot", slot_of(F.col(key_col), slots)) \
        .join(F.broadcast(table.withColumnRenamed("slot", "_flowguard_slot")), "_flowguard_slot")
    placed.repartition(len(set(shards)) * files, "shard", F.col("_flowguard_slot") % files) \
        .drop("_flowguard_slot").write.partitionBy("shard").parquet(path)


def _table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard string")
