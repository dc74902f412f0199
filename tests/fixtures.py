"""Small tables for tests."""

from datetime import datetime, timedelta

from flowguard.schema import PACKET, RULE, RULE_LOG

START = datetime(2024, 1, 1)


def packet(i=0, seconds=0.0, **fields):
    """A TCP packet; keyword fields replace the defaults."""
    row = dict(packet_id=i, ts=START + timedelta(seconds=seconds), node_id=1,
               src_mac="FF:FF:FF:FF:FF:FF", dst_mac="FF:FF:FF:FF:FF:FF", src_ip="192.168.1.1",
               dst_ip="192.168.1.2", proto="TCP", src_port=1000, dst_port=2000, flag_mask=0, payload="")
    row.update(fields)
    if row["proto"] == "IP":
        row.update(src_port=None, dst_port=None, flag_mask=None, payload=None)
    elif row["proto"] == "UDP":
        row.update(flag_mask=None)
    return row


def packets(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in PACKET.fieldNames()) for r in rows], PACKET)


def rules(spark, *rows):
    """Rules as (kind, direction, value) or (scope, kind, direction, value)."""
    return spark.createDataFrame([r if len(r) == 4 else ("all", *r) for r in rows], RULE)


def rule_log(spark, *rows):
    """Changes as (seq, seconds, scope, op, kind, direction, value)."""
    return spark.createDataFrame([(r[0], START + timedelta(seconds=r[1]), *r[2:]) for r in rows], RULE_LOG)


def nodes(spark, *pairs):
    return spark.createDataFrame(list(pairs), "node_id int, level int")
