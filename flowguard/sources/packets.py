"""Packet and rule-log scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PACKET, RULE, RULE_LOG
from ..session import pin_utc


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Read packet records from parquet with the fixed packet schema."""
    return pin_utc(spark).read.schema(PACKET).parquet(path)


def packet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Read the same records as a stream; ``files_per_trigger`` sets its pace."""
    return _paced(pin_utc(spark).readStream.schema(PACKET), files_per_trigger).parquet(path)


def rule_log(spark: SparkSession, path: str) -> DataFrame:
    """Read the log of rule changes."""
    return pin_utc(spark).read.schema(RULE_LOG).parquet(path)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a table of rules in force."""
    return spark.read.schema(RULE).parquet(path)


def _paced(reader, files_per_trigger):
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader


# The events table, whose times carry no zone.
EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets derived from an events table."""
    return packets_from_events(pin_utc(spark).read.schema(EVENT).parquet(path))


def event_packet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packets derived from an events table that is read as a stream."""
    reader = pin_utc(spark).readStream.schema(EVENT)
    return packets_from_events(_paced(reader, files_per_trigger).parquet(path))


def packets_from_events(events: DataFrame) -> DataFrame:
    """View events as packets: users are sources, the number in props the target."""
    kind, user = F.col("event_type"), F.col("user_id")
    proto = F.when(kind.isin("click", "view", "purchase"), "TCP").when(kind == "signup", "UDP").otherwise("IP")
    base = events.select(
        F.col("event_id").alias("packet_id"), F.col("ts").cast("timestamp").alias("ts"),
        user.alias("_user"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("_k"),
        proto.alias("proto"), kind.alias("_kind"), F.col("props").alias("_props"))
    k, has_ports = F.col("_k"), F.col("proto") != "IP"
    # Destination port for k % 8 = 0 .. 6; otherwise 1000 + k.
    ports = [22, 53, 80, 443, 23, 8080, 3306]
    dst_port = 1000 + k
    for i, port in reversed(list(enumerate(ports))):
        dst_port = F.when(k % 8 == i, port).otherwise(dst_port)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return base.select(
        "packet_id", "ts", F.when(k % 16 < 8, k % 8).otherwise(7).cast("int").alias("node_id"),
        F.concat(F.lit("02:00:00:00:01:"), two(F.col("_user") % 100)).alias("src_mac"),
        F.concat(F.lit("02:00:00:00:00:"), two(k % 16)).alias("dst_mac"),
        F.concat(F.lit("10.0."), F.floor(F.col("_user") / 256).cast("string"), F.lit("."),
                 (F.col("_user") % 256).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.1."), k.cast("string")).alias("dst_ip"),
        "proto",
        F.when(has_ports, 1024 + (F.col("packet_id") * 31) % 64512).cast("int").alias("src_port"),
        F.when(has_ports, dst_port).cast("int").alias("dst_port"),
        F.when(F.col("proto") == "TCP", F.col("packet_id") % 256).cast("int").alias("flag_mask"),
        F.when(has_ports, F.concat("_kind", F.lit(" "), "_props")).alias("payload"))
