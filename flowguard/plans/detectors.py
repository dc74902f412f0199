"""Anomaly detectors: packets in, reports about jumping keys out."""

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packet import slot_of
from ..operators.counts import dimension_rows
from ..operators.lookup import null_safe_join
from ..operators.moving import cma
from ..operators.screening import reached
from ..operators.windows import count_windows, sliding_counts
from ..schema import (COUNT_WINDOW, DETECTION_FLOOR, DETECTOR_BY_VERBOSITY, DETECTION_RATIO, DST_IP_REPORT,
                      PACKET_ORDER, SLOT_SECONDS, SRC_IP_REPORT, WINDOW_SLOTS)

# Only addresses are tested by default; ports and flags are counted, not tested.
TESTED = ("src_ip", "dst_ip")

# Report type per tested dimension; port jumps are reported as port hits.
_REPORT_TYPES = {"src_ip": SRC_IP_REPORT, "dst_ip": DST_IP_REPORT, "src_port": 1, "dst_port": 1, "flag": 7}

_DETECTORS: dict[str, Callable[..., DataFrame]] = {}


def register_detector(name: str, run: Callable[..., DataFrame]) -> None:
    """Add a named detector; ``run(df, **params)`` returns reports."""
    _DETECTORS[name] = run


def detector_names() -> list[str]:
    return sorted(_DETECTORS)


def detect(df: DataFrame, detector: str | int, **params) -> DataFrame:
    """Run a detector on packets, given by name or verbosity number (0 to 2)."""
    detector = DETECTOR_BY_VERBOSITY.get(detector, detector)
    if detector not in _DETECTORS:
        raise KeyError(f"unknown detector {detector!r}; known: {', '.join(detector_names())}")
    return _DETECTORS[detector](df, **params)


def detect_by_level(cascaded: DataFrame, detectors: dict[int, str | int], **params) -> DataFrame:
    """Run each level's detector on the packets that reached the level.

    Packets that a level drops are still counted there. Adds ``level``.
    """
    by_detector: dict[str, list[int]] = {}
    for level, detector in detectors.items():
        by_detector.setdefault(DETECTOR_BY_VERBOSITY.get(detector, detector), []).append(level)
    found = []
    for detector, levels in sorted(by_detector.items()):
        if detector in _BY_LEVEL:
            # One pass for all levels of a detector: a packet counts once at each level that it reached.
            seen = F.filter(F.array(*(F.when(reached(n), F.lit(n)) for n in sorted(levels))), lambda n: n.isNotNull())
            copies = cascaded.withColumn("level", F.explode(seen))
            found.append(detect(copies, detector, by=("level", "node_id"), **params))
        else:
            found += [detect(cascaded.filter(reached(n)), detector, **params).withColumn("level", F.lit(n))
                      for n in levels]
    return reduce(DataFrame.unionByName, found)


def report_type() -> Column:
    """The report code of a jump in a tested dimension."""
    out = None
    for dimension, code in _REPORT_TYPES.items():
        match = F.col("dimension") == dimension
        out = F.when(match, code) if out is None else out.when(match, code)
    return out


def detect_classic(df: DataFrame, size: int = COUNT_WINDOW, ratio: float | Column = DETECTION_RATIO,
                   floor: int = DETECTION_FLOOR, dimensions: Iterable[str] = TESTED,
                   by: Iterable[str] = ("node_id",)) -> DataFrame:
    """Jumps between count windows of each node, or of each group of the columns ``by``.

    Reports carry the window, the count, the average before it, and the time of
    the packet that closed the window.
    """
    dimensions, by = list(dimensions), list(by)
    needed = dict.fromkeys([*PACKET_ORDER, *by, "proto", *_columns(dimensions)])
    windows = count_windows(df.select(*needed), size, by)
    counts = dimension_rows(windows, [*by, "win"], dimensions) \
        .groupBy(*by, "win", "dimension", "key").agg(F.count("*").alias("n"))
    alerts = cma(counts, [*by, "dimension", "key"], "win", ratio, floor).filter("alert")
    # Only alerts need the closing time, so only they are joined with it.
    closings = windows.groupBy(*by, "win").agg(F.max("ts").alias("ts"))
    return null_safe_join(alerts, closings, [*by, "win"]).select(
        *by, "ts", "win", report_type().alias("report_type"), "key", "n", "prior")


def detect_sliding(df: DataFrame, slot_seconds: float = SLOT_SECONDS, n_slots: int = WINDOW_SLOTS,
                   ratio: float | Column = DETECTION_RATIO, floor: int = DETECTION_FLOOR,
                   dimensions: Iterable[str] = TESTED, zero_tail: bool = True,
                   t0_micros: int = 0, by: Iterable[str] = ("node_id",)) -> DataFrame:
    """Jumps between sliding time windows of each node, or of each group of the columns ``by``.

    ``win`` is the last slot of the window, ``ts`` the time at which it ends.
    """
    by = list(by)
    rows = dimension_rows(df, [*by, "ts"], list(dimensions))
    group = [*by, "dimension", "key"]
    slot = F.max(slot_of("ts", slot_seconds, t0_micros))
    if "level" in by:
        # The last slot of each level, of which there are few.
        last = {r["level"]: r["last"] for r in df.groupBy("level").agg(slot.alias("last")).collect()}
        last_slot = reduce(lambda a, n: a.when(F.col("level") == n, F.lit(last[n])), last, F.when(F.lit(False), 0))
    else:
        last_slot = df.select(slot).scalar()
    counts = sliding_counts(rows, group, slot_seconds, n_slots, zero_tail, t0_micros, last_slot)
    alerts = cma(counts, group, "end_slot", ratio, floor).filter("alert")
    length = int(round(slot_seconds * 1_000_000))
    ends = F.timestamp_micros((F.col("end_slot") + 1) * F.lit(length).cast("bigint") + t0_micros)
    return alerts.select(*by, ends.alias("ts"), F.col("end_slot").alias("win"),
                         report_type().alias("report_type"), "key", "n", "prior")


def detect_off(df: DataFrame, **_params) -> DataFrame:
    """No detection: an empty report table."""
    return df.sparkSession.createDataFrame(
        [], "node_id int, ts timestamp, win bigint, report_type int, key string, n bigint, prior bigint")


def _columns(dimensions: list[str]) -> list[str]:
    return ["flag_mask" if d == "flag" else d for d in dimensions]


register_detector("off", detect_off)
register_detector("classic", detect_classic)
register_detector("sliding", detect_sliding)

# Detectors that can group by level as well.
_BY_LEVEL = ("classic", "sliding")
