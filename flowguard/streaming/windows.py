"""Windowed and running counts on streams.

State is bounded by a watermark on event time: a window is written once, when
the watermark has passed its end. Packets may be late by ``delay``, which is one
slot or round unless it says otherwise; later ones are dropped and counted
(``query_totals``). What is open when a bounded stream ends is written if the input
ends with a ``closing_packet``.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packet import div, micros
from ..operators.reports import report_kind
from ..operators.screening import cascade, mark_known_bad
from ..schema import DEFAULT_LEVELS, HIT_KINDS, ROUND_SECONDS, SLOT_SECONDS, WINDOW_SLOTS


def interval(seconds: float) -> str:
    """A length of time as Spark's windows take it."""
    return f"{int(round(seconds * 1_000_000))} microseconds"


def panes(stream: DataFrame, keys: Iterable[str], seconds: float, delay: str | None = None) -> DataFrame:
    """Rows per key in tumbling windows: (pane, keys, n). Longer windows are made of them, never of packets."""
    watermarked = stream.withWatermark("ts", delay or interval(seconds))
    return watermarked.groupBy(F.window("ts", interval(seconds)).alias("pane"), *keys).agg(F.count("*").alias("n"))


def over_panes(seconds: float, n: int) -> Column:
    """The windows of ``n`` panes that hold a pane; they advance by one."""
    return F.window(F.window_time("pane"), interval(seconds * n), interval(seconds)).alias("w")


def stream_sliding_counts(stream: DataFrame, keys: Iterable[str], slot_seconds: float = SLOT_SECONDS,
                          n_slots: int = WINDOW_SLOTS, delay: str | None = None) -> DataFrame:
    """Hits per key in sliding windows; ``end_slot`` as in the batch form.

    Packets are counted by slot; a second aggregate adds up closed slots.
    """
    keys = list(keys)
    counts = panes(stream, keys, slot_seconds, delay)
    counts = counts.withColumnRenamed("pane", "w") if n_slots == 1 else \
        counts.groupBy(over_panes(slot_seconds, n_slots), *keys).agg(F.sum("n").alias("n"))
    length = int(round(slot_seconds * 1_000_000))
    return counts.select(*keys, (div(micros(F.col("w.end")), length) - 1).alias("end_slot"), "n")


def stream_rounds(reports: DataFrame, round_seconds: float = ROUND_SECONDS,
                  delay: str | None = None) -> DataFrame:
    """Reports per (kind, key, node) and round."""
    routed = reports.withColumn("kind", report_kind()).filter(F.col("kind").isin(*HIT_KINDS))
    counts = routed.withWatermark("ts", delay or interval(round_seconds)) \
        .groupBy(F.window("ts", interval(round_seconds)).alias("w"), "kind", "key", "node_id") \
        .agg(F.count("*").alias("hits"))
    length = int(round(round_seconds * 1_000_000))
    return counts.select("kind", "key", "node_id",
                         div(micros(F.col("w.start")), length).alias("round"), "hits")


def stream_escalation(reports: DataFrame, round_seconds: float = ROUND_SECONDS,
                      delay: str | None = None) -> DataFrame:
    """Per (kind, key, node) and round: its hits, and whether it escalates.

    Reports are counted by round. A window of two rounds that advances by one
    sees a round together with the one before, so the look back needs no state
    beyond that of the window.
    """
    routed = reports.withColumn("kind", report_kind()).filter(F.col("kind").isin(*HIT_KINDS))
    rounds = panes(routed, ["kind", "key", "node_id"], round_seconds, delay)
    length = int(round(round_seconds * 1_000_000))
    pairs = rounds.select(over_panes(round_seconds, 2), "kind", "key", "node_id", "n", F.window_time("pane").alias("at"))
    in_round = micros("at") >= micros(F.col("w.end")) - length
    total = lambda own: F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0).cast("bigint"))
    counts = pairs.groupBy("w", "kind", "key", "node_id").agg(total(in_round).alias("hits"), total(~in_round).alias("before"))
    return counts.filter(F.col("hits") > 0).select(
        "kind", "key", "node_id", (div(micros(F.col("w.end")), length) - 1).alias("round"), "hits",
        (F.col("before") > 0).alias("escalated"))


def running_counters(stream: DataFrame, rules, bad_ips: DataFrame,
                     levels: dict[int, str] = DEFAULT_LEVELS, metrics: str = "traffic") -> DataFrame:
    """Packets processed, dropped and leaked so far, per node.

    State is one row per node. The same totals per micro-batch are observable
    in the query progress under the name ``metrics``.
    """
    screened = mark_known_bad(cascade(stream, levels, rules), bad_ips, "_bad")
    lost, bad = F.col("dropped_at").isNotNull(), F.col("_bad")
    screened = screened.observe(metrics, F.count(F.lit(1)).alias("processed"),
                                F.count_if(lost).alias("dropped"))
    return screened.groupBy("node_id").agg(
        F.count("*").alias("processed"), F.count_if(lost).alias("dropped"),
        F.count_if(bad & ~lost).alias("leaked"))
