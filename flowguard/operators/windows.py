"""Count windows, time slots, sliding windows and rounds."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packet import div, slot_of
from ..schema import COUNT_WINDOW, PACKET_ORDER, ROUND_SECONDS, SLOT_SECONDS, WINDOW_SLOTS
from .ordering import number_rows


def count_windows(df: DataFrame, size: int = COUNT_WINDOW, by: Iterable[str] = ("node_id",),
                  order: Iterable[str] = PACKET_ORDER) -> DataFrame:
    """Add ``win``: every ``size`` packets of a group form a window.

    Packets of an unfinished last window are left out.
    """
    numbered = number_rows(df, by, order)
    finished = F.col("idx") < F.col("total") - F.col("total") % size
    return (numbered.filter(finished)
            .withColumn("win", div(F.col("idx"), size)).drop("idx", "total"))


def slot_counts(df: DataFrame, keys: Iterable[str], slot_seconds: float = SLOT_SECONDS,
                t0_micros: int = 0) -> DataFrame:
    """Hits per key and time slot."""
    return df.groupBy(*keys, slot_of("ts", slot_seconds, t0_micros).alias("slot")) \
        .agg(F.count("*").alias("n"))


def sliding_counts(df: DataFrame, keys: Iterable[str], slot_seconds: float = SLOT_SECONDS,
                   n_slots: int = WINDOW_SLOTS, zero_tail: bool = False,
                   t0_micros: int = 0, last_slot: Column | None = None) -> DataFrame:
    """Hits per key in windows of ``n_slots`` slots that advance by one slot.

    ``end_slot`` is the last slot of a window. Packets are first combined per
    slot; only these counts are copied to the windows that contain them.

    With ``zero_tail`` the windows are those a running counter would report:
    none after the last slot of the data (``last_slot`` if the caller knows it),
    and one final 0 for a key whose hits have all left the window.
    """
    keys = list(keys)
    # Placed by key before the copying, which also serves the sums and any later
    # step that works per key.
    per_slot = slot_counts(df, keys, slot_seconds, t0_micros).repartition(*keys)
    steps = n_slots if zero_tail else n_slots - 1
    windows = per_slot.select(
        *keys, "slot", "n",
        F.explode(F.sequence("slot", F.col("slot") + steps)).alias("end_slot"))
    value = F.when(F.col("end_slot") < F.col("slot") + n_slots, F.col("n")).otherwise(F.lit(0))
    if zero_tail:
        if last_slot is None:
            last_slot = df.select(F.max(slot_of("ts", slot_seconds, t0_micros))).scalar()
        windows = windows.filter(F.col("end_slot") <= last_slot)
    return windows.groupBy(*keys, "end_slot").agg(F.sum(value).cast("bigint").alias("n"))


def round_number(ts: str | Column = "ts", round_seconds: float = ROUND_SECONDS,
                 t0_micros: int = 0) -> Column:
    return slot_of(ts, round_seconds, t0_micros)


def window_length_ok(windows: DataFrame, n: int, nominal_seconds: int, by: Iterable[str] = ("node_id",),
                     ts: str = "ts", start: Column | None = None) -> DataFrame:
    """Add ``ok``: the time since the n-th last emission equals the nominal length.

    ``windows`` has one row per emission. ``start``, the time at which a group
    began, stands in for the missing emissions of the first ``n`` rows; without
    it they are not ok. Lengths count in whole seconds.
    """
    earlier = F.lag(ts, n).over(Window.partitionBy(*by).orderBy(ts))
    if start is not None:
        earlier = F.coalesce(earlier, start)
    length = div(F.unix_micros(ts) - F.unix_micros(earlier), 1_000_000)
    return windows.withColumn("ok", F.coalesce(length == nominal_seconds, F.lit(False)))
