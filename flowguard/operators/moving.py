"""Moving averages over per-window counts, and the jump test on them."""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DETECTION_FLOOR, DETECTION_RATIO
from .lookup import null_safe_join


def cma(counts: DataFrame, key: Iterable[str], order: str, ratio: float | Column = DETECTION_RATIO,
        floor: int = DETECTION_FLOOR, seed: str = "first", value: str = "n",
        state: DataFrame | None = None) -> DataFrame:
    """Add ``prior``, ``cma``, ``points`` and ``alert`` to per-window counts of each key.

    The average truncates to an integer at every step, so it is a fold in
    window order and not an aggregate. Counts are already one row per key and
    window. The fold runs over sorted partitions and carries one state across
    Arrow batches, so a long series never has to fit in memory.

    ``prior`` is the average before the value; ``alert`` is set when the value
    exceeds ``prior * ratio`` and ``floor``; ``ratio`` may be a column over the
    key, such as a ratio per node. The first value of a key never
    alerts. With ``seed='discard'`` that value is not counted either and the
    average starts at 0. ``points`` is the number of values in the average.

    ``state`` continues earlier series: one row (key..., cma, points) per key.
    """
    if seed not in ("first", "discard"):
        raise ValueError(f"unknown seed {seed!r}")
    key = list(key)
    # Numbering shuffles and sorts by (key, order); the fold reads that order.
    step = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    if state is None:
        counts = counts.withColumn("_average", F.lit(None).cast("bigint")) \
            .withColumn("_points", F.lit(None).cast("bigint"))
    else:
        counts = null_safe_join(counts, state.select(
            *key, F.col("cma").alias("_average"), F.col("points").alias("_points")), key, "left")
    numbered = counts.select(*key, order, F.col(value).cast("bigint").alias(value),
                             step.alias("_step"), "_average", "_points")
    added = ("prior", "cma", "points")
    schema = T.StructType([*numbered.schema.fields, *[T.StructField(c, T.LongType()) for c in added]])
    folded = numbered.mapInArrow(_folder(value, seed == "discard"), schema)
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    jump = (F.col("prior").isNotNull() & (F.col(value) > F.col("prior") * ratio)
            & (F.col(value) > floor))
    return folded.withColumn("alert", F.coalesce(jump, F.lit(False))).drop("_step", "_average", "_points")


def _folder(value: str, discard_first: bool):
    # A closure without names of this package: it travels to the workers by
    # value, which therefore need not have the package installed.
    def fold(batches):
        average, points = 0, 0
        for batch in batches:
            priors, averages, sizes = [], [], []
            columns = [batch.column(c).to_pylist() for c in (value, "_step", "_average", "_points")]
            for v, step, old_average, old_points in zip(*columns):
                if step == 1 and old_points is None:
                    priors.append(None)
                    average, points = (0, 0) if discard_first else (v, 1)
                else:
                    if step == 1:
                        average, points = old_average, old_points
                    priors.append(average)
                    average, points = (v + points * average) // (points + 1), points + 1
                averages.append(average)
                sizes.append(points)
            added = [pa.array(c, pa.int64()) for c in (priors, averages, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added],
                                             names=[*batch.schema.names, "prior", "cma", "points"])
    return fold


def last_n_average(counts: DataFrame, key: Iterable[str], order: str, n: int = 10,
                   value: str = "n") -> DataFrame:
    """Add ``avg_last``: the sum of the last ``n`` values divided by ``n``.

    Values that do not exist yet count as 0, so the divisor is always ``n``.
    """
    frame = Window.partitionBy(*key).orderBy(order).rowsBetween(1 - n, 0)
    total = F.sum(value).over(frame)
    return counts.withColumn("_sum", total).withColumn("avg_last", F.expr(f"_sum div {int(n)}")).drop("_sum")
