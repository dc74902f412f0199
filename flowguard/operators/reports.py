"""Reports sent by the screens and detectors: routing, counting, escalation."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HIT_KINDS, REPORT_KINDS, ROUND_SECONDS
from .lookup import null_safe_join
from .windows import round_number


def report_kind(report_type="report_type", kinds: dict[int, str] = REPORT_KINDS) -> Column:
    """The counter that a report code feeds; NULL for an unknown code."""
    pairs = [F.lit(x) for pair in kinds.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(report_type))


def route_reports(reports: DataFrame, kinds: dict[int, str] = REPORT_KINDS) -> DataFrame:
    """Add ``kind``, the counter a report feeds; NULL for an unknown code."""
    return reports.withColumn("kind", report_kind(kinds=kinds))


def _routed(reports: DataFrame) -> DataFrame:
    routed = reports if "kind" in reports.columns else route_reports(reports)
    return routed.filter(F.col("kind").isin(*HIT_KINDS))


def report_hits(reports: DataFrame) -> DataFrame:
    """Reports per (kind, key, node)."""
    return _routed(reports).groupBy("kind", "key", "node_id").agg(F.count("*").alias("hits"))


def report_matrix(reports: DataFrame, nodes: Iterable[int]) -> DataFrame:
    """Per (kind, key), one column of hits for each node of the given list, and ``node_other`` for all others.

    Reports of unlisted nodes, and those without a node, count in ``node_other``.
    """
    nodes = list(nodes)
    columns = [F.count_if(F.col("node_id") == n).alias(f"node_{n}") for n in nodes]
    other = ~F.coalesce(F.col("node_id").isin(*nodes), F.lit(False))
    columns.append(F.count_if(other).alias("node_other"))
    return _routed(reports).groupBy("kind", "key").agg(*columns)


_REPORTED = ["kind", "key", "node_id"]


def _rounds(routed: DataFrame, round_seconds: float, t0_micros: int, *measures: Column) -> DataFrame:
    """Measures per key and round, with ``escalated`` looking one round back."""
    rounds = routed.groupBy(*_REPORTED, round_number("ts", round_seconds, t0_micros).alias("round")) \
        .agg(*measures)
    before = F.lag("round").over(Window.partitionBy(*_REPORTED).orderBy("round"))
    return rounds.withColumn("escalated", F.coalesce(before == F.col("round") - 1, F.lit(False)))


def escalate(reports: DataFrame, round_seconds: float = ROUND_SECONDS, t0_micros: int = 0) -> DataFrame:
    """Per (kind, key, node) and round: its hits, and whether it escalates.

    A round escalates when the same key was also reported in the round just
    before. Reports are combined per round before the look back, so a key needs
    one row per round however often it is reported.
    """
    return _rounds(_routed(reports), round_seconds, t0_micros, F.count("*").alias("hits"))


def flag_reports(reports: DataFrame, round_seconds: float = ROUND_SECONDS, t0_micros: int = 0) -> DataFrame:
    """Add ``escalated`` to single reports: only the first one of an escalating round.

    ``packet_id`` must identify a report within its (kind, key, node), which
    makes the join evenly spread.
    """
    routed = _routed(reports)
    first = F.min(F.struct("ts", "packet_id")).alias("_first")
    escalating = _rounds(routed, round_seconds, t0_micros, first).filter("escalated") \
        .select(*_REPORTED, F.col("_first.packet_id").alias("packet_id"), "escalated")
    return null_safe_join(routed, escalating, [*_REPORTED, "packet_id"], "left") \
        .withColumn("escalated", F.coalesce("escalated", F.lit(False)))
