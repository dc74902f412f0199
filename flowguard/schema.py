"""Table layouts shared by batch and streaming code."""

from pyspark.sql import types as T

PACKET = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("src_mac", T.StringType()),
    T.StructField("dst_mac", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("flag_mask", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])

RULE = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("value", T.StringType()),
])

RULE_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("scope", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("value", T.StringType()),
])

EVAL = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("number", T.LongType()),
    T.StructField("kind", T.StringType()),
])

# A total order of packets: time first, then the unique id.
PACKET_ORDER = ("ts", "packet_id")

# Packet type codes.
PACKET_TYPES = {"IP": 1, "TCP": 2, "UDP": 3}

# Fixed value: number of flag counters.
FLAG_SLOTS = 9

# Report type code -> kind of counter it feeds. 0, 8 and 9 carry
# evaluation totals; 5 asks for a configuration and counts nothing.
REPORT_KINDS = {
    0: "processed",
    1: "port",
    2: "unexpected_port",
    3: "ip",
    4: "ip",
    6: "dropped",
    7: "bad_flag",
    8: "emitted",
    9: "unwanted",
}
HIT_KINDS = ("port", "unexpected_port", "ip", "unexpected_ip", "dropped", "bad_flag")

DROP_REPORT = 6
SRC_IP_REPORT = 3
DST_IP_REPORT = 4

# Default detection and window settings.
DETECTION_RATIO = 1.5
DETECTION_FLOOR = 2500
COUNT_WINDOW = 10_000
SLOT_SECONDS = 30
WINDOW_SLOTS = 2
ROUND_SECONDS = 60

# Check profile by verbosity number, and the three-level default.
PROFILE_BY_VERBOSITY = {0: "empty", 1: "basic", 2: "dpi", 3: "full"}
DEFAULT_LEVELS = {0: "basic", 1: "dpi", 2: "empty"}

# Detector by verbosity number.
DETECTOR_BY_VERBOSITY = {0: "off", 1: "classic", 2: "sliding"}
