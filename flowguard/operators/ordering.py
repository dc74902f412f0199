"""Exact positions in a total order, without ever sorting a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packet import slot_of
from ..schema import PACKET_ORDER
from ..session import materialise, scratch_path
from .lookup import bounded, null_safe_join

def in_ranges(df: DataFrame, by, order) -> DataFrame:
    """The rows, written in ranges of (by, order), with the number of each row's range in ``_range``.

    A range is what one task holds, however large a group is. What a row must
    know of its neighbours is found within (``_range``, by), and carried over
    the edges of ranges by ``carried``.
    """
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranges_in(placed: DataFrame) -> int:
    """How many ranges ``in_ranges`` has written at most: one file each."""
    return len(placed.inputFiles())


def carried(placed: DataFrame, by, value: Column, name: str, ranges: int, backwards: bool = False,
            least: bool = False) -> DataFrame:
    """Add ``name``: the last value that ranges before a row's own hold for its group (or the first of those after).

    ``value`` aggregates the rows of one group in one range; NULL means that
    the range has nothing to say. With ``least`` it is the least of all these
    values instead. One row per (range, group) is looked at, and
    only groups that go on in another range are joined; with one range there is none.
    """
    by = list(by)
    if ranges <= 1:
        kind = placed.groupBy("_range").agg(value.alias(name)).schema[name].dataType
        return placed.withColumn(name, F.lit(None).cast(kind))
    edges = placed.groupBy("_range", *by).agg(value.alias(name))
    order = F.desc("_range") if backwards else F.asc("_range")
    along = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.min(name) if least else F.last(name, ignorenulls=True)
    edges = edges.withColumn(name, found.over(along)).filter(F.col(name).isNotNull())
    return null_safe_join(placed, bounded(materialise(edges, "edges")), ["_range", *by], "left")


def number_rows(df: DataFrame, by=(), order=PACKET_ORDER) -> DataFrame:
    """Add ``idx``, the 0-based position within ``by``, and ``total`` rows of it.

    ``order`` must be a total order without NULLs. The rows are range
    partitioned on (by, order), so a hot group, or a burst in time, is split
    over as many tasks as its rows need. The sorted rows are written to the
    scratch folder, which fixes the ranges; the positions then follow from one
    small table with a row per (range, group).
    """
    by, order = list(by), list(order)
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    (df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
     .withColumn("_at", F.monotonically_increasing_id())
     .write.parquet(path))
    placed = spark.read.parquet(path)
    # The upper bits of the id number the range, the lower ones the row in it.
    placed = placed.withColumn("_range", F.shiftright("_at", 33))

    spans = placed.groupBy("_range", *by).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("_range").alias("_span"), *[F.col(c).alias(f"_by_{c}") for c in by], "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("total"))

    same = F.col("_range") == F.col("_span")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return (placed.join(bounded(spans), same)
            .withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
            .select(*df.columns, "idx", "total"))


def take_packets(df: DataFrame, n: int, order=PACKET_ORDER) -> DataFrame:
    """The first ``n`` packets in the given order, as a set of rows.

    A count per minute finds the minute in which packet ``n`` lies, and only
    packets up to it are numbered, whatever ``n`` is.
    """
    order = list(order)
    minute = slot_of(order[0], 60)
    per_minute = df.groupBy(minute.alias("_minute")).agg(F.count("*").alias("_rows"))
    reached = F.sum("_rows").over(Window.orderBy("_minute"))
    last = (per_minute.withColumn("_reached", reached).filter(F.col("_reached") >= n)
            .agg(F.min("_minute")).first()[0])
    if last is None:
        return df
    return number_rows(df.filter(minute <= last), (), order).filter(F.col("idx") < n).drop("idx", "total")
