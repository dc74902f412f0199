import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import START, nodes, packet, packets, rule_log, rules
from flowguard.operators.counts import dimension_rows
from flowguard.operators.moving import cma
from flowguard.operators.reports import escalate
from flowguard.operators.rules import cascade_as_of, rules_as_of
from flowguard.operators.windows import count_windows, slot_counts
from flowguard.session import scratch_path
from flowguard.sources.packets import packet_stream
from flowguard.streaming import (closing_packet, latest_counters, query_totals, run_counters, run_stream, run_with_rule_log, running_counters,
                                 stream_cma, stream_count_windows, stream_escalation, stream_sliding_counts,
                                 write_stream)
from flowguard.plans.detectors import detect_classic, detect_sliding
from flowguard.streaming import stateful, stream_classic_detector, stream_sliding_detector
from flowguard.streaming.run import batches_of
from flowguard.streaming.stateful import fold_closed


def traffic(n=300, seed=5, span=600):
    random.seed(seed)
    times = sorted(random.uniform(0, span) for _ in range(n))
    return [packet(i, round(t, 3), node_id=random.randint(1, 2),
                   src_ip="10.0.0.0" if random.random() < 0.33 else f"10.0.0.{random.randint(1, 5)}")
            for i, t in enumerate(times)]


def source(spark, rows, files):
    """A folder with the rows in several files, in the given order."""
    path = scratch_path(spark, "source")
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        packets(spark, rows[i:i + size]).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, rows, files, closed=False):
    path = source(spark, rows, files)
    if closed:
        closing_packet(spark, node_id=1, src_ip="10.0.0.0").write.mode("append").parquet(path)
    return packet_stream(spark, path, files_per_trigger=1)


def drained(df):
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "out")
    query = write_stream(df, path, scratch_path(spark, "commits"), available_now=True)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def rowset(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def averaged(df, *parameters, **options):
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "out")
    stream_cma(df, ["src_ip"], out, scratch_path(spark, "state"), scratch_path(spark, "commits"), 30, *parameters,
               available_now=True, **options).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("files", [1, 5])
def test_stream_cma_equals_batch(spark, files):
    rows = traffic()
    for row in rows[::7]:
        row["src_ip"] = None  # a key like any other
    got = averaged(stream(spark, rows, files, closed=True), 1.2, 2)
    batch = cma(slot_counts(packets(spark, rows), ["src_ip"], 30), ["src_ip"], "slot", 1.2, 2)
    columns = ("src_ip", "slot", "n", "prior", "cma", "alert")
    assert rowset(got, *columns) == rowset(batch, *columns)
    assert got.filter("alert").count() > 0


def test_packets_within_the_delay_still_count(spark):
    seconds = [[1, 2], [31, 32], [3], [61], [400]]
    path, i = scratch_path(spark, "source"), 0
    for part in seconds:
        packets(spark, [packet(i + j, s) for j, s in enumerate(part)]).coalesce(1).write.mode("append").parquet(path)
        i += len(part)
    got = averaged(packet_stream(spark, path, 1), delay="2 minutes")
    assert [(r["n"], r["prior"], r["cma"]) for r in got.orderBy("slot").collect()] == [(3, None, 3), (2, 3, 2), (1, 2, 1)]


def test_late_packets_are_counted(spark):
    path = scratch_path(spark, "source")
    for i, part in enumerate([[1, 2], [500], [501], [3, 4, 490]]):
        packets(spark, [packet(10 * i + j, s) for j, s in enumerate(part)]).coalesce(1).write.mode("append").parquet(path)
    closing_packet(spark, src_ip="x").write.mode("append").parquet(path)
    out, totals = scratch_path(spark, "out"), query_totals(spark)
    query = write_stream(stream_sliding_counts(packet_stream(spark, path, 1), ["src_ip"], 30, 1), out,
                         scratch_path(spark, "commits"), available_now=True)
    query.awaitTermination()
    # Both late packets of one window and key reach the state as one row.
    assert totals.late_rows(query) == 1
    spark.streams.removeListener(totals)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [2, 3]


def test_totals_outlive_the_progress_that_a_query_holds(spark):
    path, totals = scratch_path(spark, "source"), query_totals(spark)
    commits, out = scratch_path(spark, "commits"), scratch_path(spark, "out")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        def run(first, last):
            # Every batch after the first brings one packet in time and one that is much too late.
            for i in range(first, last):
                packets(spark, [packet(2 * i, 10_000 + 100 * i), packet(2 * i + 1, i)]).coalesce(1).write.mode("append").parquet(path)
            stream = packet_stream(spark, path, 1).observe("seen", F.count(F.lit(1)).alias("rows"), F.sum("packet_id").alias("ids"))
            query = write_stream(stream_sliding_counts(stream, ["src_ip"], 30, 2), out, commits, available_now=True)
            query.awaitTermination()
            return query

        query = run(0, 12)
        assert len(query.recentProgress) <= 3
        assert totals.observed(query, "seen") == {"rows": 24, "ids": sum(range(24))} and totals.late_rows(query) == 10
        # The same query goes on after a restart.
        query = run(12, 15)
        assert totals.observed(query, "seen") == {"rows": 30, "ids": sum(range(30))} and totals.late_rows(query) == 13
        assert totals.observed(query, "other") == {}
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(totals)


def test_windows_are_made_of_panes(spark):
    path = scratch_path(spark, "source")
    packets(spark, [packet(i, i % 7) for i in range(200)]).write.parquet(path)
    plan = stream_sliding_counts(packet_stream(spark, path), ["src_ip"], 30, 5)._jdf.queryExecution().analyzed().toString()
    lines = [line.strip("+-:~ ") for line in plan.splitlines()]
    counted = [i for i, line in enumerate(lines) if line.startswith("Aggregate")]
    copied = [i for i, line in enumerate(lines) if line.startswith("Expand")]
    # The first aggregate, the lower one, is that of tumbling panes; only its rows are copied into windows.
    assert len(counted) == 2 and copied and max(copied) < counted[1]


def test_replayed_batch_does_not_count_twice(spark):
    state, out = scratch_path(spark, "state"), {}
    closed = lambda slot: spark.createDataFrame([("a", slot, 10 * (slot + 1))], "key string, slot long, n long")
    write = lambda folded, batch: out.update({batch: folded.collect()[0]})
    for batch in (0, 2, 2, 3, 5, 5):
        fold_closed(closed(batch), batch, ["key"], "slot", 1.5, 0, state, write)
    assert {b: (r["prior"], r["cma"]) for b, r in out.items()} == {0: (None, 10), 2: (10, 20), 3: (20, 26), 5: (26, 34)}
    assert batches_of(spark, state) == [0, 2, 3, 5] and batches_of(spark, scratch_path(spark, "none")) == []


def test_changes_are_gathered_in_full_versions(spark, monkeypatch):
    monkeypatch.setattr(stateful, "FULL_EVERY", 2)
    rows = traffic()
    got = averaged(stream(spark, rows, 6, closed=True), 1.2, 2)
    batch = cma(slot_counts(packets(spark, rows), ["src_ip"], 30), ["src_ip"], "slot", 1.2, 2)
    columns = ("src_ip", "slot", "n", "prior", "cma", "alert")
    assert rowset(got, *columns) == rowset(batch, *columns)


@pytest.mark.parametrize("files", [1, 5])
def test_stream_detectors_equal_batch(spark, files):
    rows = traffic(n=400)
    for i, row in enumerate(rows):
        row["node_id"] = None if i % 5 == 0 else row["node_id"]
    columns = ("node_id", "ts", "win", "report_type", "key", "n", "prior")
    out = scratch_path(spark, "out")
    stream_sliding_detector(stream(spark, rows, files, closed=True), out, scratch_path(spark, "state"),
                            scratch_path(spark, "commits"), 30, 2, 1.2, 2, available_now=True).awaitTermination()
    last = max(r["ts"] for r in rows)
    batch = detect_sliding(packets(spark, rows), 30, 2, 1.2, 2)
    # A batch ends with the data, a stream goes on until all hits have left.
    got = spark.read.parquet(out).filter(F.col("ts") <= F.lit(last) + F.expr("INTERVAL 30 SECONDS"))
    assert rowset(got, *columns) == rowset(batch, *columns) != []

    out = scratch_path(spark, "out")
    stream_classic_detector(stream(spark, rows, files), out, scratch_path(spark, "state"), scratch_path(spark, "commits"),
                            25, 1.2, 2, available_now=True).awaitTermination()
    assert rowset(spark.read.parquet(out), *columns) == rowset(detect_classic(packets(spark, rows), 25, 1.2, 2), *columns) != []


@pytest.mark.parametrize("files", [1, 4])
def test_stream_count_windows_equal_batch(spark, files):
    rows = traffic()
    for row in rows[::3]:
        row["node_id"] = None
    out = scratch_path(spark, "out")
    stream_count_windows(stream(spark, rows, files), out, scratch_path(spark, "state"), scratch_path(spark, "commits"),
                         size=25, dimensions=["src_ip", "dst_port"], available_now=True).awaitTermination()
    columns = ("node_id", "win", "dimension", "key", "n")
    batch = dimension_rows(count_windows(packets(spark, rows), 25), ["node_id", "win"], ["src_ip", "dst_port"]) \
        .groupBy(*columns[:4]).agg(F.count("*").alias("n"))
    assert rowset(spark.read.parquet(out), *columns) == rowset(batch, *columns)


def as_reports(df):
    return df.select("packet_id", "ts", "node_id", F.lit(6).alias("report_type"), F.col("src_ip").alias("key"))


@pytest.mark.parametrize("files", [1, 5])
def test_stream_escalation_equals_batch(spark, files):
    rows = traffic(n=60, span=3000)
    got = drained(stream_escalation(as_reports(stream(spark, rows, files, closed=True))))
    columns = ("kind", "key", "node_id", "round", "hits", "escalated")
    batch = escalate(as_reports(packets(spark, rows)))
    assert rowset(got, *columns) == rowset(batch, *columns)
    assert len({r[-1] for r in rowset(got, *columns)}) == 2


def test_stream_sliding_counts_in_many_batches(spark):
    rows = traffic()
    one = drained(stream_sliding_counts(stream(spark, rows, 1, closed=True), ["src_ip"]))
    many = drained(stream_sliding_counts(stream(spark, rows, 6, closed=True), ["src_ip"]))
    columns = ("src_ip", "end_slot", "n")
    assert rowset(one, *columns) == rowset(many, *columns) != []


def test_outputs_survive_a_restart(spark):
    rows = traffic(n=90)
    path = source(spark, rows[:60], 2)
    sinks = {name: scratch_path(spark, name) for name in ("passed", "reports", "leaked")}
    checkpoint = scratch_path(spark, "commits")
    table = rules(spark, ("ip", "src", "10.0.0.1"))
    bad = spark.createDataFrame([("10.0.0.2",)], "ip string")
    run = lambda: run_stream(packet_stream(spark, path, 1), table, sinks, checkpoint, bad_ips=bad,
                             available_now=True).awaitTermination()
    run()
    packets(spark, rows[60:]).write.mode("append").parquet(path)
    run()
    count = lambda name: spark.read.parquet(sinks[name]).count()
    by_source = Counter(r["src_ip"] for r in rows)
    assert count("reports") == by_source["10.0.0.1"] and count("passed") == 90 - by_source["10.0.0.1"]
    assert count("leaked") == by_source["10.0.0.2"]
    with pytest.raises(ValueError):
        run_stream(packet_stream(spark, path), table, {"other": "x"}, checkpoint)


def test_running_counters_and_metrics(spark):
    rows = traffic(n=90)
    bad = spark.createDataFrame([("10.0.0.2",)], "ip string")
    out = scratch_path(spark, "counters")
    counters = running_counters(stream(spark, rows, 3), rules(spark, ("ip", "src", "10.0.0.1")), bad)
    query = run_counters(counters, out, scratch_path(spark, "commits"), available_now=True)
    query.awaitTermination()
    final = latest_counters(spark.read.parquet(out)).agg(F.sum("processed"), F.sum("dropped"), F.sum("leaked")).first()
    by_source = Counter(r["src_ip"] for r in rows)
    assert tuple(final) == (90, by_source["10.0.0.1"], by_source["10.0.0.2"])
    seen = sum(p["observedMetrics"]["traffic"]["processed"] for p in query.recentProgress if "traffic" in p["observedMetrics"])
    assert seen == 90


def test_rule_changes_between_batches(spark):
    rows = [packet(i, 10 * i, src_ip="10.0.0.1") for i in range(6)]
    log = rule_log(spark, (1, 15, "all", "add", "ip", "src", "10.0.0.1"), (2, 35, "all", "reset", None, None, None))
    out = scratch_path(spark, "out")
    run_with_rule_log(stream(spark, rows, 3), lambda: log, nodes(spark, (1, 0)), out, scratch_path(spark, "commits"),
                      available_now=True).awaitTermination()
    got = spark.read.parquet(out).orderBy("packet_id").collect()
    assert [r["verdict"] for r in got] == [True, True, False, False, True, True]
    assert got[0]["ts"] == START + timedelta(0)


def test_levels_and_reports_under_a_log(spark):
    rows = [packet(i, 10 * i, src_ip="10.0.0.1") for i in range(6)]
    log = rule_log(spark, (1, 15, "level:1", "profile", None, None, "basic"), (2, 16, "level:1", "add", "ip", "src", "10.0.0.1"),
                   (3, 35, "level:1", "reset", None, None, None))
    out, sent = scratch_path(spark, "out"), scratch_path(spark, "reports")
    run_with_rule_log(stream(spark, rows, 3), lambda: log, nodes(spark, (1, 0)), out, scratch_path(spark, "commits"),
                      {0: "basic", 1: "dpi"}, sent, available_now=True).awaitTermination()
    assert [r["dropped_at"] for r in spark.read.parquet(out).orderBy("packet_id").collect()] == [None, None, 1, 1, None, None]
    assert sorted(r["packet_id"] for r in spark.read.parquet(sent).collect()) == [2, 3]
    with pytest.raises(ValueError):
        run_with_rule_log(stream(spark, rows, 1), lambda: log, nodes(spark, (1, 0)), out, "x", reports_path=sent)


@pytest.mark.parametrize("levels", [None, {0: "basic", 1: "dpi"}])
def test_rule_state_follows_a_growing_log(spark, levels):
    random.seed(12)
    changes = []
    for seq in range(160):
        scope = random.choice(["all", "level:0", "level:1", "node:1", "node:2"])
        op = random.choice(["add", "add", "remove", "add", "remove", "reset", "profile"] if seq % 9 == 0 else ["add", "add", "remove"])
        kind, direction, value = random.choice([("ip", "src", "10.0.0.1"), ("ip", "src", "10.0.0.2"), ("port", "dst", "5"), ("pattern", None, "bad.*")])
        if op == "reset":
            kind = direction = value = None
        if op == "profile":
            kind, direction, value = None, None, random.choice(["basic", "full", "dpi", "nonsense"])
        changes.append((seq, 10 * seq, scope, op, kind, direction, value))
    rows = [packet(i, 2 * i + 1, src_ip=f"10.0.0.{random.randint(1, 3)}", dst_port=random.choice([5, 6]), node_id=random.choice([1, 2]),
                   proto=random.choice(["TCP", "UDP", "IP"]), payload=random.choice(["bad x", "good"])) for i in range(800)]
    source, out, commits, state = (scratch_path(spark, n) for n in ("source", "out", "commits", "state"))
    here, read = nodes(spark, (1, 0), (2, 1)), []

    def run(upto):
        def read_log():
            read.append(upto)
            return rule_log(spark, *changes[:upto])
        run_with_rule_log(packet_stream(spark, source, 1), read_log, here, out, commits, levels, available_now=True, state_path=state) \
            .awaitTermination()

    # The log grows between runs, by nothing once; a packet of the last run comes very late.
    for first, last, upto in ((0, 250, 51), (250, 500, 101), (500, 505, 101), (505, 790, 160), (790, 800, 160)):
        packets(spark, rows[first:last]).coalesce(1).write.mode("append").parquet(source)
        run(upto)
    late = packet(9000, 333, src_ip="10.0.0.1", dst_port=5, node_id=1, payload="bad x")
    packets(spark, [late]).coalesce(1).write.mode("append").parquet(source)
    run(160)
    df, log = packets(spark, [*rows, late]), rule_log(spark, *changes)
    want = rules_as_of(df, log, here) if levels is None else cascade_as_of(df, log, here, levels)
    column = "verdict" if levels is None else "dropped_at"
    as_map = lambda table: {r["packet_id"]: r[column] for r in table.select("packet_id", column).collect()}
    assert as_map(spark.read.parquet(out)) == as_map(want) and len(set(as_map(want).values())) >= 2
    # A batch without new rows writes no version, and a version holds what is open and what has ended since.
    versions = batches_of(spark, f"{state}/seen")
    assert len(versions) == 3 and len(read) == 6
    ended = [spark.read.parquet(f"{state}/rules/batch={v}").filter("end IS NOT NULL").count() for v in versions]
    assert all(0 < n < 120 for n in ended)
