import pytest
from pyspark.sql import functions as F

from fixtures import nodes, packet, packets, rules
from flowguard.functions.checks import payload_ok, profile_ok, register_profile
from flowguard.operators.rules import RuleBook
from flowguard.operators.screening import (cascade, dropped, leaked, mark_monitored, merge_typed, processed,
                                           profile_by_level, screen, split_by_type, split_verdict)


def verdicts(spark, rows, profile, *rule_rows):
    rows = [{**r, "packet_id": i} for i, r in enumerate(rows)]
    got = screen(packets(spark, rows), profile, rules(spark, *rule_rows)).select("packet_id", "verdict")
    return [ok for _, ok in sorted(map(tuple, got.collect()))]


def verdict(spark, row, profile, *rule_rows):
    return verdicts(spark, [row], profile, *rule_rows)[0]


BLOCKS = [
    ("port", "src", "1000", ("TCP", "UDP")),
    ("port", "dst", "2000", ("TCP", "UDP")),
    ("ip", "src", "192.168.1.1", ("TCP", "UDP", "IP")),
    ("ip", "dst", "192.168.1.2", ("TCP", "UDP", "IP")),
    ("flags", None, "0", ("TCP",)),
]


@pytest.mark.parametrize("kind,direction,value,protos", BLOCKS)
def test_basic_profile_drops_listed_values(spark, kind, direction, value, protos):
    order = ("TCP", "UDP", "IP")
    got = verdicts(spark, [packet(proto=p) for p in order], "basic", (kind, direction, value))
    assert got == [p not in protos for p in order]


def test_joined_sets_give_the_same_verdicts(spark):
    table = rules(spark, *[b[:3] for b in BLOCKS], ("ip", "src", "::1"), ("pattern", None, "x+"))
    rows = [packet(i, proto=p, **change) for i, (p, change) in enumerate(
        (p, c) for p in ("TCP", "UDP", "IP", "GRE") for c in (
            {}, {"src_port": 1}, {"src_port": 1, "dst_port": 1}, {"src_port": None, "dst_port": 1, "src_ip": "1.1.1.1"},
            {"src_port": 1, "dst_port": 1, "src_ip": "0:0::1", "dst_ip": "1.1.1.1", "flag_mask": 3},
            {"src_port": 1, "dst_port": 1, "src_ip": None, "dst_ip": "1.1.1.1", "flag_mask": 3, "payload": "xx"},
            {"src_port": 1, "dst_port": 1, "src_ip": "1.1.1.1", "dst_ip": "1.1.1.1", "flag_mask": 3}))]
    results = []
    for book in (RuleBook.load(table), RuleBook.load(table, 0, 1000), RuleBook.load(table, 0, 0)):
        got = screen(packets(spark, rows), "full", book).select("packet_id", "verdict")
        results.append(sorted(map(tuple, got.collect())))
    assert results[0] == results[1] == results[2]
    assert {ok for _, ok in results[0]} == {True, False}


def test_other_direction_is_not_blocked(spark):
    assert verdict(spark, packet(), "basic", ("port", "src", "2000"))
    assert verdict(spark, packet(), "basic", ("ip", "src", "192.168.1.2"))


def test_flags_match_as_a_whole(spark):
    row = packet(flag_mask=135)
    assert not verdict(spark, row, "basic", ("flags", None, "135"))
    assert verdict(spark, row, "basic", ("flags", None, "7"))


def test_payload_signature_full_and_find(spark):
    text = "This is not permitted"
    for proto in ("TCP", "UDP"):
        assert not verdict(spark, packet(proto=proto, payload=text), "dpi", ("pattern", None, text))
    book = RuleBook.load(rules(spark, ("pattern", None, "not")))
    df = packets(spark, [packet(payload=text), packet(payload=None), packet(payload="not"), packet(payload="not\n")])
    assert [r[0] for r in df.select(payload_ok(book)).collect()] == [True, True, False, True]
    assert [r[0] for r in df.select(payload_ok(book, "find")).collect()] == [False, True, False, False]


def test_empty_profile_passes_everything(spark):
    assert verdict(spark, packet(), "empty", ("flags", None, "0"), ("ip", "src", "192.168.1.1"))


def test_unknown_type_passes_basic_and_dpi_but_not_full(spark):
    table = [("ip", "src", "192.168.1.1"), ("pattern", None, ".*")]
    rows = [packet(proto="ICMP"), packet(proto=None)]
    assert verdicts(spark, rows, "basic", *table) == verdicts(spark, rows, "dpi", *table) == [True, True]
    assert verdicts(spark, rows, "full", *table) == [False, False]


def test_null_fields_pass(spark):
    row = packet(src_port=None, flag_mask=None, payload=None, src_ip=None)
    assert verdict(spark, row, "full", ("port", "src", "1"), ("flags", None, "0"), ("ip", "src", "1.1.1.1"),
                   ("pattern", None, ".*"))


def test_addresses_meet_in_normal_form(spark):
    spelled = [("192.168.001.1", "192.168.1.1"), ("::ffff:192.168.1.7", "192.168.1.7"), ("192.168.1.8", "::FFFF:192.168.1.8"),
               ("fe80::1", "FE80:0:0:0:0:0:0:1"), ("::1", "0:0:0:0:0:0:0:1"), ("2001:db8::", "2001:DB8:0::0")]
    rows = [packet(src_ip=seen) for seen, _ in spelled]
    assert not any(verdicts(spark, rows, "basic", *[("ip", "src", listed) for _, listed in spelled]))
    assert all(verdicts(spark, rows, "basic", ("ip", "src", "10.1.1.1"), ("ip", "src", "fe80::2")))
    # Dotted rules alone leave the IPv6 form out of the plan.
    assert verdicts(spark, rows, "basic", ("ip", "src", "192.168.1.7")) == [True, False, True, True, True, True]


def test_values_with_quotes_are_taken_as_they_are(spark):
    odd = "a'b\\c"
    assert not verdict(spark, packet(src_ip=odd), "basic", ("ip", "src", odd))


def test_scopes(spark):
    rows = [packet(i, node_id=n) for i, n in enumerate((1, 2))]
    table = rules(spark, ("node:2", "port", "src", "1000"), ("level:1", "ip", "src", "192.168.1.1"))
    for book in (RuleBook.load(table), RuleBook.load(table, 0, 1000), RuleBook.load(table, 0, 0)):
        got = cascade(packets(spark, rows), {0: "basic", 1: "basic"}, book).orderBy("packet_id")
        assert [r["dropped_at"] for r in got.collect()] == [1, 0]


def test_many_scopes_become_a_table(spark):
    table = rules(spark, *[(f"node:{n}", "port", "src", "1000") for n in range(40)])
    book = RuleBook.load(table)
    assert book.tables and not book.inline
    got = screen(packets(spark, [packet(node_id=39), packet(1, node_id=40)]), "basic", book).orderBy("packet_id")
    assert [r["verdict"] for r in got.collect()] == [False, True]


def test_profile_by_level(spark):
    rows = [packet(i, node_id=i, payload="bad") for i in range(4)]
    got = profile_by_level(packets(spark, rows), {0: "empty", 1: "dpi", 2: "basic"},
                           rules(spark, ("pattern", None, "bad"), ("port", "src", "1000")),
                           nodes(spark, (0, 0), (1, 1), (2, 2), (3, 9)))
    assert {r["node_id"]: r["verdict"] for r in got.collect()} == {0: True, 1: False, 2: False, 3: True}


def test_cascade_counts(spark):
    rows = [packet(0, src_ip="10.0.0.9"), packet(1, payload="aaa"), packet(2), packet(3, proto="IP", src_ip="10.0.0.9")]
    screened = cascade(packets(spark, rows), rules=rules(spark, ("ip", "src", "10.0.0.9"), ("pattern", None, "aaa")))
    assert [r["dropped_at"] for r in screened.orderBy("packet_id").collect()] == [0, 1, None, 0]
    assert {(r["level"], r["n"]) for r in processed(screened).collect()} == {(0, 4), (1, 2), (2, 1)}
    assert dropped(screened).first()["n"] == 3
    assert {tuple(r) for r in dropped(screened, ["src_ip"]).collect()} == {("10.0.0.9", 2), ("192.168.1.1", 1)}


def test_drop_report_names_the_source(spark):
    screened = screen(packets(spark, [packet()]), "basic", rules(spark, ("flags", None, "0")))
    passed, reports = split_verdict(screened)
    assert passed.count() == 0
    assert [(r["node_id"], r["report_type"], r["key"]) for r in reports.collect()] == [(1, 6, "192.168.1.1")]


def test_monitored_marks_and_keeps(spark):
    got = mark_monitored(packets(spark, [packet(), packet(1, src_ip="1.1.1.1")]),
                         rules(spark, ("monitored_ip", "src", "192.168.1.1"))).orderBy("packet_id")
    assert [r["monitored"] for r in got.collect()] == [True, False]


def test_leaked(spark):
    bad = spark.createDataFrame([("192.168.001.1",), ("192.168.1.1",)], "ip string")
    assert leaked(packets(spark, [packet(), packet(1, src_ip="1.1.1.1")]), bad).count() == 1


def test_split_and_merge(spark):
    rows = [packet(0), packet(1, proto="UDP"), packet(2, proto="IP"), packet(3, proto="GRE"), packet(4, proto=None)]
    ip, tcp, udp, rejected = split_by_type(packets(spark, rows))
    assert [d.count() for d in (ip, tcp, udp, rejected)] == [1, 1, 1, 2]
    assert "src_port" not in ip.columns and "flag_mask" not in udp.columns
    merged = merge_typed(ip, tcp, udp)
    assert {(r["packet_id"], r["proto"]) for r in merged.collect()} == {(0, "TCP"), (1, "UDP"), (2, "IP")}


def test_custom_profile(spark):
    register_profile("only_port_80", lambda book, level=None: F.col("dst_port") == 80)
    df = packets(spark, [packet(), packet(1, dst_port=80)])
    assert [r[0] for r in df.select(profile_ok("only_port_80", None)).collect()] == [False, True]
    with pytest.raises(KeyError):
        profile_ok("no_such_profile", None)


def test_rules_are_checked_in_the_scan_stage(spark):
    df = cascade(packets(spark, [packet()]), rules=rules(spark, ("ip", "src", "10.0.0.9")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
