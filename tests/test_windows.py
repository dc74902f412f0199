import random
from collections import Counter, defaultdict, deque
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import START, packet, packets
from flowguard.operators.counts import all_hits, flag_hits, flag_rows, hits, port_hits
from flowguard.operators.moving import cma, last_n_average
from flowguard.operators.ordering import number_rows, take_packets
from flowguard.operators.windows import count_windows, sliding_counts, slot_counts, window_length_ok
from flowguard.plans import detect, detect_by_level, detect_classic, detect_sliding, register_detector


def burst(n=600, seed=1, keys=6):
    """Packets of which a third share one source, one node and one second."""
    random.seed(seed)
    rows = []
    for i in range(n):
        if random.random() < 0.33:
            rows.append(packet(i, 100.5, node_id=1, src_ip="10.0.0.0"))
        else:
            rows.append(packet(i, random.randint(0, 1000), node_id=random.randint(1, 3),
                               src_ip=f"10.0.0.{random.randint(0, keys)}"))
    random.shuffle(rows)
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r["ts"], r["packet_id"]))


def test_numbering_is_exact(spark):
    rows = burst()
    got = number_rows(packets(spark, rows).repartition(5), ["node_id"]).collect()
    want, seen = {}, Counter()
    for r in in_order(rows):
        want[r["packet_id"]] = seen[r["node_id"]]
        seen[r["node_id"]] += 1
    assert {r["packet_id"]: r["idx"] for r in got} == want
    assert {r["node_id"]: r["total"] for r in got} == dict(seen)


def test_numbering_keeps_null_groups(spark):
    rows = [packet(i, i, node_id=None if i % 2 else 1) for i in range(10)]
    got = number_rows(packets(spark, rows), ["node_id"]).collect()
    assert sorted(r["idx"] for r in got) == sorted([0, 1, 2, 3, 4] * 2)


@pytest.mark.parametrize("n", [0, 1, 37, 250, 600, 1000])
def test_take_packets(spark, n):
    rows = burst()
    df = packets(spark, rows)
    want = {r["packet_id"] for r in in_order(rows)[:n]}
    assert {r["packet_id"] for r in take_packets(df, n).collect()} == want


def test_unfinished_count_window_gives_nothing(spark):
    rows = [packet(i, i, node_id=1) for i in range(25)] + [packet(100 + i, i, node_id=2) for i in range(9)]
    got = count_windows(packets(spark, rows), 10).collect()
    assert Counter((r["node_id"], r["win"]) for r in got) == {(1, 0): 10, (1, 1): 10}


def running_counter(per_slot, n_slots):
    """A ring of slots per key: read totals, forget empty keys, clear a slot, advance."""
    ring, head, out = defaultdict(lambda: [0] * n_slots), 0, []
    for slot in sorted(per_slot):
        for key, n in per_slot[slot].items():
            ring[key][head] += n
        out += [(key, slot, sum(v)) for key, v in ring.items()]
        for key in [k for k, v in ring.items() if not sum(v)]:
            del ring[key]
        head = (head + 1) % n_slots
        for v in ring.values():
            v[head] = 0
    return out


@pytest.mark.parametrize("n_slots,seed", [(2, 1), (3, 2), (5, 3)])
def test_sliding_counts_against_a_running_counter(spark, n_slots, seed):
    random.seed(seed)
    rows = [packet(i, random.randint(0, 40) * 30 + 1, src_ip=f"10.0.0.{int(random.paretovariate(1)) % 9}") for i in range(120)]
    first = min(r["ts"] for r in rows)
    base = int((first - START).total_seconds()) // 30
    last = max(int((r["ts"] - START).total_seconds()) // 30 for r in rows)
    per_slot = {s: Counter() for s in range(base, last + 1)}
    for r in rows:
        per_slot[int((r["ts"] - START).total_seconds()) // 30][r["src_ip"]] += 1
    t0 = int(START.timestamp() * 1_000_000) if START.tzinfo else None
    epoch_slot = (START - START.__class__(1970, 1, 1)) // timedelta(seconds=30)
    got = sliding_counts(packets(spark, rows), ["src_ip"], 30, n_slots, zero_tail=True).collect()
    assert t0 is None
    assert sorted((r["src_ip"], r["end_slot"] - epoch_slot, r["n"]) for r in got) == sorted(running_counter(per_slot, n_slots))
    assert any(r["n"] == 0 for r in got)


def test_load_up_example(spark):
    # One hit in each of four minutes, counted over five minutes.
    rows = [packet(i, 60 * i + 1) for i in range(4)] + [packet(9, 60 * 9 + 1, src_ip="other")]
    got = sliding_counts(packets(spark, rows), ["src_ip"], 60, 5, zero_tail=True).filter("src_ip = '192.168.1.1'")
    assert [r["n"] for r in got.orderBy("end_slot").collect()] == [1, 2, 3, 4, 4, 3, 2, 1, 0]


def test_slots_before_the_epoch(spark):
    df = spark.sql("SELECT timestamp_micros(-1) AS ts UNION ALL SELECT timestamp_micros(0)")
    assert sorted(r["slot"] for r in slot_counts(df, [], 30).collect()) == [-1, 0]


@pytest.mark.parametrize("seed", ["first", "discard"])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_cma_fold_against_steps(spark, seed, batch):
    random.seed(7)
    series = {k: [random.randint(1, 9999) for _ in range(random.randint(1, 40))] for k in range(12)}
    rows = [(k, w, v) for k, values in series.items() for w, v in enumerate(values)]
    random.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = cma(spark.createDataFrame(rows, "k int, w int, n bigint"), ["k"], "w", 1.5, 100, seed).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, values in series.items():
        average, points, started = 0, 0, False
        for w, v in enumerate(values):
            if not started:
                prior, started = None, True
                average, points = (v, 1) if seed == "first" else (0, 0)
            else:
                prior = average
                average, points = (v + points * average) // (points + 1), points + 1
            want[k, w] = (prior, average, prior is not None and v > prior * 1.5 and v > 100)
    assert {(r["k"], r["w"]): (r["prior"], r["cma"], r["alert"]) for r in got} == want


def test_last_ten_average(spark):
    random.seed(3)
    values = [random.randint(1, 9999) for _ in range(25)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, w int, n bigint")
    recent, want = deque(maxlen=10), []
    for v in values:
        recent.append(v)
        want.append(sum(recent) // 10)
    assert [r["avg_last"] for r in last_n_average(df, ["k"], "w").orderBy("w").collect()] == want
    steady = spark.createDataFrame([("a", i, 1000) for i in range(12)], "k string, w int, n bigint")
    assert last_n_average(steady, ["k"], "w").orderBy(F.desc("w")).first()["avg_last"] == 1000


def test_window_length(spark):
    ticks = [(1, START + timedelta(seconds=s)) for s in (30, 60, 90, 150, 180, 210)]
    df = spark.createDataFrame(ticks, "node_id int, ts timestamp")
    ok = lambda d: [r["ok"] for r in d.orderBy("ts").collect()]
    assert ok(window_length_ok(df, 2, 60)) == [False, False, True, False, False, True]
    start = F.lit(START)
    assert ok(window_length_ok(df, 2, 60, start=start)) == [False, True, True, False, False, True]


def test_counters(spark):
    rows = [packet(0, flag_mask=135), packet(1, proto="UDP", dst_port=53), packet(2, proto="IP"), packet(3, flag_mask=1)]
    df = packets(spark, rows)
    assert {tuple(r) for r in hits(df, "src_ip").collect()} == {(1, "192.168.1.1", 4)}
    assert {tuple(r) for r in hits(df, "dst_port").collect()} == {(1, 2000, 2), (1, 53, 1)}
    assert {r["flag"]: r["n"] for r in flag_hits(df).collect()} == {0: 2, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}
    assert Counter(r["packet_id"] for r in flag_rows(df).collect()) == {0: 4, 3: 1}
    assert {(r["port"], r["n"]) for r in port_hits(df).collect()} == {(1000, 3), (2000, 2), (53, 1)}
    whole = {(r["dimension"], r["key"]): r["n"] for r in all_hits(df).collect()}
    assert whole["src_port", "1000"] == 3 and whole["flag", "0"] == 2 and whole["dst_ip", "192.168.1.2"] == 4
    assert len(whole) == 9


def test_classic_detector_reports_a_jump(spark):
    rows, i = [], 0
    for window, hot in enumerate([3, 3, 9]):
        for j in range(10):
            rows.append(packet(i, i, src_ip="10.0.0.1" if j < hot else f"10.0.{window}.{j}", dst_ip=f"1.1.1.{i}"))
            i += 1
    got = detect_classic(packets(spark, rows), size=10, ratio=1.5, floor=5).collect()
    assert [(r["win"], r["report_type"], r["key"], r["n"], r["prior"]) for r in got] == [(2, 3, "10.0.0.1", 9, 3)]
    assert got[0]["ts"] == START + timedelta(seconds=29)


def test_sliding_detector_reports_a_jump(spark):
    rows = [packet(i, 1 + (i % 4) * 30) for i in range(8)] + [packet(100 + i, 121) for i in range(20)]
    got = detect_sliding(packets(spark, rows), floor=10).collect()
    assert {(r["report_type"], r["key"], r["n"]) for r in got} == {(3, "192.168.1.1", 22), (4, "192.168.1.2", 22)}
    assert {r["ts"] for r in got} == {START + timedelta(seconds=150)}


def test_detectors_by_level_and_verbosity(spark):
    rows = [packet(i, 1 + i) for i in range(3)] + [packet(100 + i, 31) for i in range(20)]
    passed = packets(spark, rows).withColumn("dropped_at", F.lit(None).cast("int"))
    got = detect_by_level(passed, {0: 0, 2: 2}, floor=10, dimensions=["src_ip"]).collect()
    assert [(r["level"], r["n"]) for r in got] == [(2, 23)]
    early = passed.withColumn("dropped_at", F.lit(1))
    assert detect_by_level(early, {1: "sliding", 2: "sliding"}, floor=10, dimensions=["src_ip"]) \
        .select("level").collect() == [(1,)]


def test_ratio_may_depend_on_the_key(spark):
    df = spark.createDataFrame([(k, w, 10 * (w + 1)) for k in (1, 2) for w in (0, 1)], "k int, w int, n bigint")
    got = cma(df, ["k"], "w", F.when(F.col("k") == 1, 1.5).otherwise(2.5), 0).filter("alert")
    assert [(r["k"], r["w"]) for r in got.collect()] == [(1, 1)]


def test_cma_continues_an_earlier_series(spark):
    values = [5, 9, 1, 30, 2, 8]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, w int, n bigint")
    whole = cma(df, ["k"], "w").orderBy("w").collect()
    first = cma(df.filter("w < 3"), ["k"], "w")
    state = first.groupBy("k").agg(F.max_by("cma", "w").alias("cma"), F.max("points").alias("points"))
    rest = cma(df.filter("w >= 3").union(spark.createDataFrame([("b", 3, 7)], df.schema)), ["k"], "w", state=state)
    assert rest.filter("k = 'a'").orderBy("w").collect() == whole[3:]
    assert tuple(rest.filter("k = 'b'").select("prior", "cma").first()) == (None, 7)


def test_detector_registry(spark):
    df = packets(spark, [packet()])
    assert detect(df, "off").count() == 0
    register_detector("all", lambda d, **_: d.select("node_id"))
    assert detect(df, "all").count() == 1
    with pytest.raises(KeyError):
        detect(df, "none such")
