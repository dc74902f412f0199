"""Evaluation of one run: what was emitted, processed, dropped and missed."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import BROADCAST_ROWS
from ..operators.screening import mark_known_bad, reached
from ..schema import DEFAULT_LEVELS


def evaluate(cascaded: DataFrame, bad_ips: DataFrame, run: str,
             levels: Iterable[int] = tuple(DEFAULT_LEVELS),
             broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (run, component, number, kind) from one pass over screened packets.

    EMITTED counts packets from known bad sources, UNWANTED those of them that
    passed every level.
    """
    levels = sorted(levels)
    marked = mark_known_bad(cascaded, bad_ips, "_bad", broadcast_rows)
    bad, passed = F.col("_bad"), F.col("dropped_at").isNull()
    lines = [("Emitter", bad, "EMITTED")]
    lines += [(f"LVL{n}", reached(n), "PROCESSED") for n in levels]
    lines += [("OVERALL", ~passed, "DROPPED"), ("Aggregator", bad & passed, "UNWANTED")]
    totals = marked.agg(*[F.count_if(condition).alias(f"_n{i}") for i, (_, condition, _) in enumerate(lines)])
    cells = ", ".join(f"'{component}', _n{i}, '{kind}'" for i, (component, _, kind) in enumerate(lines))
    return totals.select(F.lit(run).alias("run"),
                         F.expr(f"stack({len(lines)}, {cells}) AS (component, number, kind)"))


def rates(cascaded: DataFrame, bad_ips: DataFrame, run: str,
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Shares of bad packets detected and leaked, and of good ones dropped."""
    marked = mark_known_bad(cascaded, bad_ips, "_bad", broadcast_rows)
    bad, passed = F.col("_bad"), F.col("dropped_at").isNull()
    n = marked.agg(F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good"),
                   F.count_if(bad & ~passed).alias("caught"), F.count_if(bad & passed).alias("leaked"),
                   F.count_if(~bad & ~passed).alias("false_drops"))
    return n.select(F.lit(run).alias("run"), F.try_divide("caught", "bad").alias("detection_rate"),
                    F.try_divide("leaked", "bad").alias("leak_rate"),
                    F.try_divide("false_drops", "good").alias("false_drop_rate"))
