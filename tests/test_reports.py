import random
from datetime import timedelta

import pytest

from fixtures import START, packet, packets, rules
from flowguard.operators.reports import escalate, flag_reports, report_hits, report_matrix, route_reports
from flowguard.operators.screening import cascade
from flowguard.plans import evaluate, rates
from flowguard.schema import REPORT_KINDS
from flowguard.session import scratch_path
from flowguard.sources.packets import packet_stream, packets as read_packets
from flowguard.sources.packets import rule_log, rules as read_rules
from flowguard.sources.sinks import merge_reports, read_eval, write_by_proto, write_eval, write_reports

REPORT = "packet_id bigint, ts timestamp, node_id int, report_type int, key string"


def reports(spark, *rows):
    return spark.createDataFrame([(i, START + timedelta(seconds=s), n, t, k) for i, (s, n, t, k) in enumerate(rows)], REPORT)


@pytest.mark.parametrize("code,key,kind", [
    (1, "1000", "port"), (2, "1000", "unexpected_port"), (3, "192.168.1.1", "ip"), (4, "192.168.1.1", "ip"),
    (6, "192.168.1.1", "dropped"), (7, "1", "bad_flag")])
def test_a_report_lands_in_its_counter(spark, code, key, kind):
    got = report_hits(reports(spark, (0, 2, code, key))).collect()
    assert [tuple(r) for r in got] == [(kind, key, 2, 1)]


def test_totals_and_unknown_codes_are_no_hits(spark):
    df = reports(spark, *[(0, 1, code, "x") for code in (0, 5, 8, 9, 42)])
    assert report_hits(df).count() == 0
    assert {r["report_type"]: r["kind"] for r in route_reports(df).collect()} == {
        0: "processed", 5: None, 8: "emitted", 9: "unwanted", 42: None}
    assert report_hits(route_reports(df, {**REPORT_KINDS, 42: "unexpected_ip"})).first()["kind"] == "unexpected_ip"


def test_matrix(spark):
    df = reports(spark, (0, 1, 1, "80"), (0, 1, 1, "80"), (0, 3, 1, "80"), (0, 2, 3, "a"))
    df = df.union(reports(spark, (0, 9, 1, "80"), (0, None, 1, "80")))
    got = {(r["kind"], r["key"]): tuple(r)[2:] for r in report_matrix(df, [1, 2, 3]).collect()}
    assert got == {("port", "80"): (2, 0, 1, 2), ("ip", "a"): (0, 1, 0, 0)}


def test_escalation_against_steps(spark):
    random.seed(11)
    rows = sorted((random.randint(0, 1500), random.randint(1, 3), random.choice([1, 3, 6]), f"k{random.randint(0, 2)}")
                  for _ in range(400))
    df = reports(spark, *rows)
    last, want = {}, {}
    for i, (s, node, code, key) in enumerate(rows):
        group, number = (code, key, node), s // 60
        want[i] = last.get(group, -2) == number - 1
        last[group] = number
    got = {r["packet_id"]: r["escalated"] for r in flag_reports(df).collect()}
    assert got == want
    per_round = escalate(df).collect()
    assert sum(r["hits"] for r in per_round) == 400
    assert sum(r["escalated"] for r in per_round) == sum(want.values()) > 0


def test_evaluation(spark):
    rows = [packet(0, src_ip="10.0.0.9"), packet(1, payload="aaa"), packet(2, src_ip="10.0.0.8"), packet(3)]
    screened = cascade(packets(spark, rows), rules=rules(spark, ("ip", "src", "10.0.0.9"), ("pattern", None, "aaa")))
    bad = spark.createDataFrame([("10.0.0.9",), ("10.0.0.8",)], "ip string")
    got = evaluate(screened, bad, "r")
    assert [tuple(r) for r in got.collect()] == [
        ("r", "Emitter", 2, "EMITTED"), ("r", "LVL0", 4, "PROCESSED"), ("r", "LVL1", 3, "PROCESSED"),
        ("r", "LVL2", 2, "PROCESSED"), ("r", "OVERALL", 2, "DROPPED"), ("r", "Aggregator", 1, "UNWANTED")]
    assert tuple(rates(screened, bad, "r").first()) == ("r", 0.5, 0.5, 0.5)
    none = spark.createDataFrame([], "ip string")
    assert rates(screened, none, "r").first()["detection_rate"] is None
    path = scratch_path(spark, "eval")
    write_eval(got, path)
    write_eval(got, path)
    assert read_eval(spark, path).count() == 12


def test_sinks_and_scans(spark):
    path = scratch_path(spark, "packets")
    rows = [packet(0), packet(1, proto="UDP"), packet(2, proto="IP"), packet(3, proto="GRE")]
    write_by_proto(packets(spark, rows), path)
    back = read_packets(spark, path)
    assert {(r["packet_id"], r["proto"], r["src_port"]) for r in back.collect()} == {
        (0, "TCP", 1000), (1, "UDP", 1000), (2, "IP", None)}
    assert packet_stream(spark, path, 1).isStreaming
    out = scratch_path(spark, "reports")
    write_reports(merge_reports(reports(spark, (0, 1, 1, "a")), reports(spark, (0, 1, 6, "b")).drop("ts")), out)
    assert spark.read.parquet(out).filter("report_type = 6").first()["key"] == "b"
    table = scratch_path(spark, "rules")
    rules(spark, ("ip", "src", "a")).write.parquet(table)
    assert read_rules(spark, table).first()["value"] == "a"
    assert rule_log(spark, table).count() == 1
