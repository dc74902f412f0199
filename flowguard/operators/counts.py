"""Hit counters per address, port and flag.

Each is one hash aggregate: Spark combines per task before the shuffle, so a
key with a third of all packets sends one row per task.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packet import flag_is_set
from ..schema import FLAG_SLOTS

DIMENSIONS = ("src_ip", "dst_ip", "src_port", "dst_port")


def counted(dimension: str) -> Column:
    """Whether a packet counts for a dimension: ports only for TCP and UDP."""
    if dimension.endswith("_port"):
        return F.col("proto").isin("TCP", "UDP")
    return F.lit(True)


def hits(df: DataFrame, dimension: str, by: Iterable[str] = ("node_id",)) -> DataFrame:
    """Packets per key of one dimension."""
    return (df.filter(counted(dimension) & F.col(dimension).isNotNull())
            .groupBy(*by, F.col(dimension).alias("key")).agg(F.count("*").alias("n")))


def flag_rows(df: DataFrame) -> DataFrame:
    """One row per packet and set flag."""
    return df.filter(F.col("proto") == "TCP").select("packet_id", F.explode(_flags()).alias("flag"))


def flag_hits(df: DataFrame, by: Iterable[str] = ("node_id",)) -> DataFrame:
    """TCP packets per flag; all flag slots are listed, also those never set."""
    by = list(by)
    counts = df.filter(F.col("proto") == "TCP").groupBy(*by).agg(
        *[F.sum(flag_is_set(i).cast("bigint")).alias(f"_flag_{i}") for i in range(FLAG_SLOTS)])
    pairs = ", ".join(f"{i}, _flag_{i}" for i in range(FLAG_SLOTS))
    return counts.select(*by, F.expr(f"stack({FLAG_SLOTS}, {pairs}) AS (flag, n)"))


def port_hits(df: DataFrame, by: Iterable[str] = ("node_id",)) -> DataFrame:
    """Hits per port, source and destination alike."""
    by = list(by)
    ports = df.filter(counted("src_port")).select(*by, F.explode(F.array("src_port", "dst_port")).alias("port"))
    return ports.filter(F.col("port").isNotNull()).groupBy(*by, "port").agg(F.count("*").alias("n"))


def dimension_rows(df: DataFrame, keep: Iterable[str],
                   dimensions: Iterable[str] = DIMENSIONS + ("flag",)) -> DataFrame:
    """Unpivot packets to rows (keep..., dimension, key), one per counter they hit."""
    dimensions = list(dimensions)
    cells = [F.when(counted(d) & F.col(d).isNotNull(),
                    F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")))
             for d in dimensions if d != "flag"]
    rows = F.array_compact(F.array(*cells))
    if "flag" in dimensions:
        flag_cells = F.transform(_flags(), lambda i: F.struct(
            F.lit("flag").alias("dimension"), i.cast("string").alias("key")))
        rows = F.concat(rows, F.when(F.col("proto") == "TCP", flag_cells)
                        .otherwise(F.array().cast("array<struct<dimension:string,key:string>>")))
    return df.select(*keep, F.explode(rows).alias("_row")).select(*keep, "_row.dimension", "_row.key")


def all_hits(df: DataFrame, by: Iterable[str] = ("node_id",)) -> DataFrame:
    """Hits of every dimension from one scan and one aggregate."""
    by = list(by)
    return dimension_rows(df, by).groupBy(*by, "dimension", "key").agg(F.count("*").alias("n"))


def _flags() -> Column:
    set_bits = [F.when(flag_is_set(i), F.lit(i)) for i in range(FLAG_SLOTS)]
    return F.array_compact(F.array(*set_bits))
