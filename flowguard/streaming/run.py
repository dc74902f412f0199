"""Running screened streams into files.

Every writer is restartable: plain file sinks track their own commits, and
per-batch writers put batch ``n`` into the folder ``batch=n`` and overwrite it
when the batch is replayed.
"""

import re
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.storagelevel import StorageLevel

from ..operators.screening import as_book, cascade, drop_reports, leaked
from ..schema import DEFAULT_LEVELS, PACKET


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to parquet files."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(writer, checkpoint, available_now)


def per_batch(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
              available_now: bool = False, mode: str = "append") -> StreamingQuery:
    return _start(df.writeStream.outputMode(mode).foreachBatch(step), checkpoint, available_now)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def batches_of(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the ``batch=<n>`` folders in a folder; its files are not listed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = (status.getPath().getName() for status in files.listStatus(folder))
    return sorted(int(found[1]) for found in (re.fullmatch(r"batch=(\d+)", name) for name in names) if found)


def run_stream(packets: DataFrame, rules, sinks: dict[str, str], checkpoint: str,
               levels: dict[int, str] = DEFAULT_LEVELS, bad_ips: DataFrame | None = None,
               available_now: bool = False) -> StreamingQuery:
    """Screen a stream once per micro-batch and write several outputs.

    ``sinks`` maps ``passed``, ``reports`` (drops) and ``leaked`` to folders;
    outputs without a folder are not computed.
    """
    unknown = set(sinks) - {"passed", "reports", "leaked"}
    if unknown:
        raise ValueError(f"unknown sinks: {sorted(unknown)}")
    if "leaked" in sinks and bad_ips is None:
        raise ValueError("the leaked output needs bad_ips")
    book = as_book(rules)

    def step(batch: DataFrame, batch_id: int) -> None:
        screened = cascade(batch, levels, book).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            passed = screened.filter(F.col("dropped_at").isNull()).drop("dropped_at")
            if "passed" in sinks:
                write_batch(passed, sinks["passed"], batch_id)
            if "reports" in sinks:
                write_batch(drop_reports(screened.filter(F.col("dropped_at").isNotNull())),
                            sinks["reports"], batch_id)
            if "leaked" in sinks:
                write_batch(leaked(passed, bad_ips), sinks["leaked"], batch_id)
        finally:
            screened.unpersist()

    return per_batch(packets, step, checkpoint, available_now)


class QueryTotals(StreamingQueryListener):
    """Adds up what queries report per micro-batch, for as long as they live: late rows and observed metrics.

    A query's own progress keeps only its latest micro-batches. Totals belong to
    the query, not to one run of it: a batch that is run again counts once.
    """

    def __init__(self):
        self._late: dict[str, int] = {}
        self._observed: dict[str, dict[tuple[str, str], int]] = {}
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        """Nothing is to be done before the first batch."""

    def onQueryIdle(self, event) -> None:
        """A trigger without data changes no total."""

    def onQueryTerminated(self, event) -> None:
        """Totals stay readable after the end."""

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        query, batch = str(progress.id), progress.batchId
        # Progress without a batch is only a sign of life.
        if "addBatch" not in progress.durationMs or batch <= self._last.get(query, -1):
            return
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self._late[query] = self._late.get(query, 0) + late
        sums = self._observed.setdefault(query, {})
        for name, row in progress.observedMetrics.items():
            for metric, value in row.asDict().items():
                sums[name, metric] = sums.get((name, metric), 0) + (value or 0)
        self._last[query] = batch

    def _settle(self, query: StreamingQuery, seconds: float = 30.0) -> str:
        """Wait until the last batch that the query has reported has come here too."""
        last, until = query.lastProgress, time.monotonic() + seconds
        while last and "addBatch" in last["durationMs"] and self._last.get(str(query.id), -1) < last["batchId"]:
            if time.monotonic() > until:
                raise TimeoutError(f"batch {last['batchId']} has not been reported")
            time.sleep(0.02)
        return str(query.id)

    def late_rows(self, query: StreamingQuery) -> int:
        """Rows that a query has dropped as too late, over all of its batches.

        A windowed count combines the packets of one task, window and key before
        it looks at their time, so these count as one row.
        """
        return self._late.get(self._settle(query), 0)

    def observed(self, query: StreamingQuery, name: str) -> dict[str, int]:
        """The sums of observed metrics of that name over all batches of a query."""
        sums = self._observed.get(self._settle(query), {})
        return {metric: value for (own, metric), value in sums.items() if own == name}


def query_totals(spark: SparkSession) -> QueryTotals:
    """Totals of all queries of a session that start from now on."""
    totals = QueryTotals()
    spark.streams.addListener(totals)
    return totals


def closing_packet(spark: SparkSession, **fields) -> DataFrame:
    """One packet so late that it closes every window before it, as the last file of a bounded stream.

    Its own windows stay open, so that it is never counted. ``fields`` replace
    its NULLs where a stream keeps only some packets.
    """
    row = {"packet_id": -1, "ts": datetime(9000, 1, 1), "proto": "IP", **fields}
    return spark.createDataFrame([tuple(row.get(name) for name in PACKET.fieldNames())], PACKET)


def run_counters(counters: DataFrame, path: str, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """Write running counters (one row per node) after every micro-batch."""
    return per_batch(counters, lambda batch, batch_id: write_batch(batch, path, batch_id),
                     checkpoint, available_now, mode="complete")


def latest_counters(df: DataFrame) -> DataFrame:
    """The last written state of running counters."""
    return df.filter(F.col("batch") == df.select(F.max("batch")).scalar()).drop("batch")
