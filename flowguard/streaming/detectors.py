"""Detectors on streams: jumping keys of closed windows, written as reports.

Windows are counted by Spark's windowed aggregates or by the count windows of
``counted``; closed ones are folded into the averages of their keys, which are
kept as small tables between micro-batches.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.packet import div, micros
from ..operators.counts import dimension_rows
from ..operators.lookup import null_safe_join
from ..plans.detectors import TESTED, report_type
from ..schema import COUNT_WINDOW, DETECTION_FLOOR, DETECTION_RATIO, SLOT_SECONDS, WINDOW_SLOTS
from .counted import stream_count_windows
from .run import per_batch, write_batch
from .stateful import fold_closed
from .windows import over_panes, panes

GROUP = ["node_id", "dimension", "key"]


def stream_sliding_detector(stream: DataFrame, path: str, state_path: str, checkpoint: str,
                            slot_seconds: float = SLOT_SECONDS, n_slots: int = WINDOW_SLOTS,
                            ratio: float = DETECTION_RATIO, floor: int = DETECTION_FLOOR,
                            dimensions: Iterable[str] = TESTED, delay: str | None = None,
                            available_now: bool = False) -> StreamingQuery:
    """Write a report for every jump between sliding windows of a node: node_id, ts, win, report_type, key, n, prior.

    Windows advance by a slot. A window one slot longer shows the keys whose
    hits have just left, which count 0 once, as a running counter has it.
    """
    length = int(round(slot_seconds * 1_000_000))
    rows = dimension_rows(stream, ["node_id", "ts"], list(dimensions))
    slots = panes(rows, GROUP, slot_seconds, delay)
    slots = slots.select(over_panes(slot_seconds, n_slots + 1), *GROUP, "n", F.window_time("pane").alias("at"))
    counts = slots.groupBy("w", *GROUP).agg(
        F.coalesce(F.sum(F.when(micros("at") >= micros(F.col("w.start")) + length, F.col("n"))), F.lit(0).cast("bigint")).alias("n")) \
        .select(*GROUP, (div(micros(F.col("w.end")), length) - 1).alias("win"), "n")

    def write(folded: DataFrame, batch_id: int) -> None:
        ends = F.timestamp_micros((F.col("win") + 1) * F.lit(length).cast("bigint"))
        alerts = folded.filter("alert").select("node_id", ends.alias("ts"), "win",
                                               report_type().alias("report_type"), "key", "n", "prior")
        write_batch(alerts, path, batch_id)

    return per_batch(counts, lambda batch, batch_id: fold_closed(
        batch, batch_id, GROUP, "win", ratio, floor, state_path, write), checkpoint, available_now)


def stream_classic_detector(stream: DataFrame, path: str, state_path: str, checkpoint: str, size: int = COUNT_WINDOW,
                            ratio: float = DETECTION_RATIO, floor: int = DETECTION_FLOOR,
                            dimensions: Iterable[str] = TESTED, available_now: bool = False) -> StreamingQuery:
    """Write a report for every jump between count windows of a node, when the window is complete.

    Columns as those of ``stream_sliding_detector``; ``ts`` is the time of the
    packet that completed the window.
    """
    def completed(counts: DataFrame, batch_id: int) -> None:
        closings = counts.groupBy("node_id", "win").agg(F.max("ts").alias("ts"))

        def write(folded: DataFrame, batch_id: int) -> None:
            alerts = null_safe_join(folded.filter("alert"), closings, ["node_id", "win"])
            write_batch(alerts.select("node_id", "ts", "win", report_type().alias("report_type"), "key", "n", "prior"),
                        path, batch_id)

        fold_closed(counts.drop("ts"), batch_id, GROUP, "win", ratio, floor, f"{state_path}/averages", write)

    return stream_count_windows(stream, None, f"{state_path}/windows", checkpoint, size, dimensions,
                                available_now, completed)
