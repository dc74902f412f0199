"""Count windows over a stream."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..functions.packet import div
from ..operators.counts import DIMENSIONS, dimension_rows
from ..operators.lookup import Lookup, bounded, look_up, null_safe_join
from ..operators.ordering import number_rows
from ..schema import COUNT_WINDOW, PACKET_ORDER
from .run import per_batch, write_batch


def _node_key():
    """The node as a text key; packets without a node are a group as well."""
    return F.coalesce(F.col("node_id").cast("string"), F.lit("none"))


def stream_count_windows(stream: DataFrame, path: str | None, state_path: str, checkpoint: str,
                         size: int = COUNT_WINDOW, dimensions: Iterable[str] = DIMENSIONS,
                         available_now: bool = False,
                         completed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write hits (node_id, win, dimension, key, n) of every completed window.

    ``completed`` is handed the same rows of each micro-batch with ``ts``, the
    time of the last packet that hit the key in the window.

    The state between micro-batches is two small tables per batch: how many
    packets each node has had, and the counts of its open window (one window of
    packets per node at most). Numbering and counting a batch are distributed,
    so a node with a third of all packets is not one task's work. Order follows
    the packets within a batch and the batches among themselves.
    """
    dimensions = list(dimensions)
    columns = dict.fromkeys([*PACKET_ORDER, "node_id", "proto",
                             *["flag_mask" if d == "flag" else d for d in dimensions]])
    counts_key = ["node_id", "win", "dimension", "key"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        numbered = number_rows(batch.select(*columns), ["node_id"])
        totals = numbered.groupBy("node_id").agg(F.max("total").alias("seen"))
        if batch_id > 0:
            seen = spark.read.parquet(f"{state_path}/seen/batch={batch_id - 1}")
            earlier = seen.select(_node_key().alias("key"), F.col("seen").alias("_before"))
            numbered = look_up(numbered, [Lookup(_node_key(), earlier)])
            totals = totals.unionByName(seen).groupBy("node_id").agg(F.sum("seen").alias("seen"))
        else:
            numbered = numbered.withColumn("_before", F.lit(0))
        position = F.col("idx") + F.coalesce("_before", F.lit(0))
        rows = dimension_rows(numbered.withColumn("win", div(position, size)),
                              ["node_id", "win", "ts"], dimensions)
        counts = rows.groupBy(*counts_key).agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
        if batch_id > 0:
            open_before = spark.read.parquet(f"{state_path}/open/batch={batch_id - 1}")
            counts = counts.unionByName(open_before).groupBy(*counts_key) \
                .agg(F.sum("n").alias("n"), F.max("ts").alias("ts"))
        write_batch(totals, f"{state_path}/seen", batch_id)
        seen_now = spark.read.parquet(f"{state_path}/seen/batch={batch_id}")
        counts = null_safe_join(counts, bounded(seen_now), ["node_id"]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            done = F.col("win") < div(F.col("seen"), size)
            if path is not None:
                write_batch(counts.filter(done).drop("seen", "ts"), path, batch_id)
            if completed is not None:
                completed(counts.filter(done).drop("seen"), batch_id)
            write_batch(counts.filter(~done).drop("seen"), f"{state_path}/open", batch_id)
        finally:
            counts.unpersist()

    return per_batch(stream, step, checkpoint, available_now)
