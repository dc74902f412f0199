"""Moving averages on a stream.

The hits of a slot are counted by a windowed aggregate, whose state and late
packets Spark handles. Only closed slots reach the average, which is folded per
micro-batch for all keys at once: state operators that call Python per key cost
milliseconds for each, too much for a table of addresses.
"""

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..operators.moving import cma
from ..schema import DETECTION_FLOOR, DETECTION_RATIO, SLOT_SECONDS
from .run import batches_of, per_batch, write_batch
from .windows import stream_sliding_counts

# A version with all averages follows so many with changes only.
FULL_EVERY = 16


def stream_cma(stream: DataFrame, keys: Iterable[str], path: str, state_path: str, checkpoint: str,
               slot_seconds: float = SLOT_SECONDS, ratio: float = DETECTION_RATIO,
               floor: int = DETECTION_FLOOR, delay: str | None = None,
               available_now: bool = False) -> StreamingQuery:
    """Write one row per key and closed slot: keys, slot, n, prior, cma, alert.

    A slot closes when the watermark passes its end; packets may be late by
    ``delay``, one slot unless it says otherwise. The averages reached so far
    are kept in ``state_path``, see ``fold_closed``.
    """
    keys = list(keys)
    counts = stream_sliding_counts(stream, keys, slot_seconds, 1, delay).withColumnRenamed("end_slot", "slot")

    def write(folded: DataFrame, batch_id: int) -> None:
        write_batch(folded.drop("points"), path, batch_id)

    return per_batch(counts, lambda batch, batch_id: fold_closed(
        batch, batch_id, keys, "slot", ratio, floor, state_path, write), checkpoint, available_now)


def fold_closed(batch: DataFrame, batch_id: int, keys: list[str], order: str, ratio: float, floor: int,
                state_path: str, write: Callable[[DataFrame, int], None]) -> None:
    """Continue the averages of the keys of a batch of closed windows, and hand the folded rows to ``write``.

    A micro-batch writes only the averages that it changed. Every
    ``FULL_EVERY``-th version holds all of them, so that a batch reads one full
    version and fewer than so many changes.
    """
    spark = batch.sparkSession
    # Kept, since every action on it would run the windowed aggregate again.
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    folded = None
    try:
        if batch.isEmpty():
            return
        versions = [b for b in batches_of(spark, state_path) if b < batch_id]
        full = max((b for b in batches_of(spark, f"{state_path}/full") if b < batch_id), default=-1)
        changes = [b for b in versions if b > full]
        before = averages(spark, state_path, full, changes, keys)
        folded = cma(batch, keys, order, ratio, floor, state=before).persist(StorageLevel.MEMORY_AND_DISK)
        write(folded, batch_id)
        reached = folded.groupBy(*keys).agg(F.max_by("cma", order).alias("cma"), F.max("points").alias("points"))
        write_batch(reached, state_path, batch_id)
        if len(changes) + 1 >= FULL_EVERY:
            write_batch(averages(spark, state_path, full, [*changes, batch_id], keys), f"{state_path}/full", batch_id)
    finally:
        batch.unpersist()
        if folded is not None:
            folded.unpersist()


def averages(spark: SparkSession, state_path: str, full: int, changes: list[int], keys: list[str]) -> DataFrame | None:
    """The latest average of each key: (keys, cma, points), or None before the first."""
    parts = [spark.read.parquet(f"{state_path}/full/batch={full}").withColumn("_batch", F.lit(full))] if full >= 0 else []
    parts += [spark.read.parquet(f"{state_path}/batch={b}").withColumn("_batch", F.lit(b)) for b in changes]
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        F.max_by("cma", "_batch").alias("cma"), F.max_by("points", "_batch").alias("points"))
