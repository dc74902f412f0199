import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import START, nodes, packet, packets, rule_log, rules
from flowguard.operators import lookup, ordering, signatures
from flowguard.operators import rules as rules_module
from flowguard.operators.lookup import Lookup, look_up
from flowguard.functions import bits, checks
from flowguard.operators.rules import (RuleBook, cascade_as_of, current_rules, expand_scope, rejected_rules, rule_intervals,
                                       rules_as_of)
from flowguard.operators.screening import screen

DAY = 86_400


def at(value):
    return None if value is None else int((value - START).total_seconds())


def test_intervals_ignore_repeats_and_end_at_reset(spark):
    log = rule_log(spark,
                   (1, 2 * DAY, "all", "add", "ip", "src", "10.0.0.3"), (2, 4 * DAY, "all", "add", "ip", "src", "10.0.0.3"),
                   (3, 9 * DAY, "all", "remove", "ip", "src", "10.0.0.3"), (4, 11 * DAY, "all", "add", "ip", "src", "10.0.0.7"),
                   (5, 19 * DAY, "all", "reset", None, None, None), (6, 25 * DAY, "all", "add", "ip", "src", "10.0.0.7"))
    got = rule_intervals(log, nodes(spark, (0, 0))).collect()
    assert sorted((r["value"], at(r["start"]) // DAY, r["end"] and at(r["end"]) // DAY) for r in got) == [
        ("10.0.0.3", 2, 9), ("10.0.0.7", 11, 19), ("10.0.0.7", 25, None)]


def test_current_rules(spark):
    log = rule_log(spark, (1, 0, "all", "add", "ip", "src", "a"), (2, 1, "all", "remove", "ip", "src", "a"),
                   (3, 2, "node:1", "add", "port", None, "5"), (4, 3, "node:2", "add", "port", "dst", "6"),
                   (5, 4, "node:1", "reset", None, None, None), (6, 5, "node:01", "add", "flags", None, "7"),
                   (7, 6, "zone:1", "add", "flags", None, "8"), (8, 7, "all", "add", "port", "both", "9"))
    here = nodes(spark, (1, 0), (2, 1))
    assert {tuple(r) for r in current_rules(log, here).collect()} == {
        (2, "port", "dst", "6"), (1, "flags", None, "7")}


def test_resets_and_removals_of_a_node_reach_rules_for_all(spark):
    log = rule_log(spark, (1, 0, "all", "add", "ip", "src", "10.0.0.1"), (2, 1, "node:2", "remove", "ip", "src", "::ffff:a00:1"),
                   (3, 2, "level:1", "reset", None, None, None))
    here = nodes(spark, (1, 0), (2, 0), (3, 1))
    assert {tuple(r) for r in current_rules(log, here).collect()} == {(1, "ip", "src", "10.0.0.1")}
    open_ = rule_intervals(log, here).filter("end IS NULL")
    assert [r["node_id"] for r in open_.collect()] == [1]


ODD_RULES = [("zone:0", "port", "src", "1000"), ("node:01", "port", "src", "1001"), (None, "port", "src", "1002"),
             ("all", "port", "both", "1003"), ("level:x", "ip", "src", "10.0.0.1"), ("all", "port", None, "01004"),
             ("node:2", "flags", "both", "7"), ("all", "port", "dst", "x"), ("all", "speed", None, "1"),
             ("all", "ip", None, "::ffff:a00:5"), ("node:", "port", "src", "1006")]


@pytest.mark.parametrize("inline_rows", [0, 1, 2000])
def test_a_rule_means_the_same_at_any_size(spark, inline_rows):
    rows = [packet(i, src_port=1000 + i, node_id=1) for i in range(8)] \
        + [packet(10, src_ip="10.0.0.5"), packet(11, src_ip="10.0.0.1"), packet(12, flag_mask=7, node_id=2)]
    book = RuleBook.load(rules(spark, *ODD_RULES), inline_rows=inline_rows)
    got = screen(packets(spark, rows), "full", book).filter("NOT verdict")
    assert {r["packet_id"] for r in got.collect()} == {1, 4, 10, 12}
    rejected = rejected_rules(rules(spark, *ODD_RULES)).collect()
    assert sorted(r["reason"] for r in rejected) == ["direction", "kind", "scope", "scope", "scope", "scope", "value"]


def test_only_the_sets_that_a_check_reads_are_joined(spark):
    table = rules(spark, *[("all", "port", d, str(i)) for d in ("src", "dst") for i in range(50)],
                  *[("all", "ip", "src", f"10.0.0.{i}") for i in range(50)])
    book = RuleBook.load(table, inline_rows=0)
    df = packets(spark, [packet(0)])
    joins = lambda out: out._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(screen(df, "dpi", book)) == 0
    assert joins(book.add(df, ok=lambda b: checks.ip_ok(b, "src"))) == 1
    # Ports are bits, whatever their number.
    assert joins(book.add(df, ok=lambda b: checks.port_ok(b, "src"))) == 0
    assert joins(screen(df, "basic", book)) == 1


def test_many_signatures(spark):
    patterns = [f"attack {i} .*" for i in range(12_000)] + [r"(x)\1", "(?i)quiet", r"\Qa.b\E"]
    rows = [packet(0, payload="attack 7 now"), packet(1, payload="attack 11999 x"), packet(2, payload="attack 12000 x"),
            packet(3, payload="xx"), packet(4, payload="QUIET"), packet(5, payload="a.b"), packet(6, payload="acb"),
            packet(7, payload="an attack 7 now"), packet(8, payload=None)]
    df = packets(spark, rows)
    book = RuleBook.load(rules(spark, *[("all", "pattern", None, p) for p in patterns]))
    assert {r["packet_id"] for r in screen(df, "dpi", book).filter("NOT verdict").collect()} == {0, 1, 3, 4, 5}
    log = rule_log(spark, *[(i, -1, "all", "add", "pattern", None, p) for i, p in enumerate(patterns)])
    late = rules_as_of(df, log, nodes(spark, (1, 0)))
    assert {r["packet_id"] for r in late.filter("NOT verdict").collect()} == {0, 1, 3, 4, 5}


def test_profiles_over_time(spark):
    log = rule_log(spark, (1, -1, "all", "add", "ip", "src", "192.168.1.1"))
    df = packets(spark, [packet(0), packet(1, proto="ICMP"), packet(2, src_ip="10.0.0.1")])
    passed = lambda profile: {r["packet_id"] for r in rules_as_of(df, log, nodes(spark, (1, 0)), profile=profile)
                              .filter("verdict").collect()}
    assert passed("full") == {2} and passed("basic") == {1, 2} and passed("dpi") == {0, 1, 2}


def test_expand_scope(spark):
    table = rules(spark, ("all", "ip", "src", "a"), ("level:1", "ip", "src", "b"), ("node:2", "ip", "src", "c"))
    got = expand_scope(table, nodes(spark, (1, 0), (2, 1)))
    assert {(r["node_id"], r["value"]) for r in got.collect()} == {(1, "a"), (2, "a"), (2, "b"), (2, "c")}


def random_case(seed, n_rules=4, changes=120, n_packets=400):
    """A random log and traffic in which a third of all rows share one value."""
    random.seed(seed)
    log, seconds = [], 0
    for seq in range(changes):
        seconds += random.randint(1, 20)
        scope = random.choice(["all", "level:0", "level:1", "node:1", "node:2"])
        kind = random.choice(["ip", "ip", "port", "pattern"])
        if random.random() < 0.04:
            log.append((seq, seconds, scope, "reset", None, None, None))
            continue
        value = 0 if random.random() < 0.33 else random.randint(0, n_rules)
        text = {"ip": f"10.0.0.{value}", "port": str(1000 + value), "pattern": f"p{value}.*"}[kind]
        log.append((seq, seconds, scope, random.choice(["add", "remove"]), kind,
                    {"ip": "src", "port": "dst"}.get(kind), text))
    rows = [packet(i, random.randint(0, seconds + 10), node_id=random.choice([1, 2, 3]),
                   src_ip=f"10.0.0.{0 if random.random() < 0.33 else random.randint(0, 9)}",
                   dst_port=1000 + random.randint(0, 9), proto=random.choice(["TCP", "UDP", "IP"]),
                   payload=f"p{random.randint(0, 9)} x") for i in range(n_packets)]
    return log, rows


def simulate(log, rows, levels):
    """Apply every change to per-node rule sets, step by step."""
    events = sorted([(s, 0, e) for e in log for s in [e[1]]] +
                    [(at(p["ts"]), 1, p) for p in rows], key=lambda e: (e[0], e[1]))
    sets = {n: set() for n in levels}
    passed = {}
    for _, is_packet, e in events:
        if is_packet:
            inside = sets[e["node_id"]]
            hit = ("ip", e["src_ip"]) in inside
            if e["proto"] != "IP":
                hit |= ("port", str(e["dst_port"])) in inside
                hit |= any(k == "pattern" and e["payload"].startswith(v[:-2]) for k, v in inside)
            passed[e["packet_id"]] = not hit
            continue
        _, _, scope, op, kind, _, value = e
        for node, level in levels.items():
            if scope in ("all", f"level:{level}", f"node:{node}"):
                if op == "reset":
                    sets[node].clear()
                elif op == "add":
                    sets[node].add((kind, value))
                else:
                    sets[node].discard((kind, value))
    return passed


@pytest.mark.parametrize("many,slices,broadcast_rows", [(64, 1024, 10_000), (1, 8, 10_000), (1, 8, 0), (64, 1024, 0)])
def test_rules_as_of_against_step_simulation(spark, monkeypatch, many, slices, broadcast_rows):
    monkeypatch.setattr(rules_module, "MANY_INTERVALS", many)
    monkeypatch.setattr(rules_module, "TIME_SLICES", slices)
    log, rows = random_case(seed=many + slices)
    levels = {1: 0, 2: 1, 3: 1}
    got = rules_as_of(packets(spark, rows), rule_log(spark, *log), nodes(spark, *levels.items()), broadcast_rows)
    got = {r["packet_id"]: r["verdict"] for r in got.collect()}
    assert got == simulate(log, rows, levels)
    assert len(set(got.values())) == 2


@pytest.fixture
def many_ranges(spark):
    """As many ranges as shuffle partitions, however few rows there are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_intervals_across_ranges(spark, many_ranges):
    log, rows = random_case(seed=77, n_rules=2, changes=300)
    levels = {1: 0, 2: 1, 3: 1}
    got = rules_as_of(packets(spark, rows), rule_log(spark, *log), nodes(spark, *levels.items()))
    assert {r["packet_id"]: r["verdict"] for r in got.collect()} == simulate(log, rows, levels)


def test_all_changes_at_one_node_and_rule(spark, many_ranges):
    changes = [(i, 2 * i, "node:1", "reset" if i % 50 == 49 else "remove" if i % 3 == 2 else "add", "port", "src", "7") for i in range(600)]
    log = rule_log(spark, *[c if c[3] != "reset" else (*c[:4], None, None, None) for c in changes])
    inside, want, start = False, [], None
    for _, second, _, op, *_ in changes:
        if (op == "add") != inside:
            if inside:
                want.append((start, second))
            inside, start = not inside, second
    if inside:
        want.append((start, None))
    got = rule_intervals(log, nodes(spark, (1, 0))).collect()
    assert sorted((at(r["start"]), at(r["end"])) for r in got) == want and len(want) > 150
    placed = ordering.in_ranges(spark.range(1000).select(F.lit(1).alias("node"), "id"), ["node"], ["id"])
    assert placed.groupBy("_range").count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("ranges", [1, 8])
def test_later_rows_of_a_log_may_lie_earlier_in_time(spark, ranges, request, monkeypatch):
    if ranges > 1:
        request.getfixturevalue("many_ranges")
    monkeypatch.setattr(rules_module, "MANY_INTERVALS", 4)
    random.seed(3)
    changes = []
    for seq in range(240):
        op = random.choice(["add", "add", "remove"] * 5 + ["reset", "profile"])
        value = {"reset": None, "profile": random.choice(["basic", "empty"])}.get(op, f"10.0.0.{random.randint(1, 3)}")
        kind, direction = (None, None) if op in ("reset", "profile") else ("ip", "src")
        # Four runs over the same time, one after the other in the log.
        changes.append((seq, 10 * (seq % 60) + random.randint(0, 30), random.choice(["all", "node:1", "node:2"]), op, kind, direction, value))
    rows = [packet(i, i, node_id=1 + i % 2, src_ip=f"10.0.0.{random.randint(1, 3)}") for i in range(640)]

    def states(node, second):
        """What the last row of each rule, and of the profile, says among all rows no later than a time."""
        held, profile = set(), "full"
        for _, ts, scope, op, _, _, value in changes:
            if ts <= second and scope in ("all", f"node:{node}"):
                held = held | {value} if op == "add" else held - {value} if op == "remove" else set()
                profile = value if op == "profile" else profile
        return held, profile

    want, dropped = {}, {}
    for p in packets(spark, rows).collect():
        held, profile = states(p["node_id"], at(p["ts"]))
        want[p["packet_id"]] = p["src_ip"] not in held
        dropped[p["packet_id"]] = 0 if p["src_ip"] in held and profile != "empty" else None
    log, here = rule_log(spark, *changes), nodes(spark, (1, 0), (2, 0))
    got = rules_as_of(packets(spark, rows), log, here).select("packet_id", "verdict").collect()
    assert len(got) == 640 and dict(map(tuple, got)) == want and len(set(want.values())) == 2
    got = cascade_as_of(packets(spark, rows), log, here, {0: "full"}).select("packet_id", "dropped_at").collect()
    assert len(got) == 640 and dict(map(tuple, got)) == dropped


def test_many_profile_changes_of_one_node(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(rules_module, "TIME_SLICES", 16)
    names = ["basic", "empty", "full"]
    log = rule_log(spark, *[(i, i, "node:1", "profile", None, None, names[i % 3]) for i in range(1000)])
    rows = [packet(i, i + 0.5, node_id=1, proto="ICMP") for i in range(-1, 1010)] + [packet(5000, 500, node_id=2, proto="ICMP")]
    got = {r["packet_id"]: r["dropped_at"] for r in cascade_as_of(packets(spark, rows), log, nodes(spark, (1, 0), (2, 0)), {0: "empty"}).collect()}
    # Only the full profile stops a packet of an unknown type.
    assert got == {**{i: 0 if i >= 0 and min(i, 999) % 3 == 2 else None for i in range(-1, 1010)}, 5000: None}
    sliced = rules_module._with_slices(rules_module.profile_intervals(log, nodes(spark, (1, 0))), ["node_id"])
    assert {r["slices"] for r in sliced.select("slices").distinct().collect()} == {1024}


def test_lookup_paths_agree_on_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 20)
    monkeypatch.setattr(lookup, "SALTS", 7)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot")
                                  .when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.range(0, 1500).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
                                        F.col("id").alias("v"))
    looks = lambda: [Lookup(F.col("k"), table)]
    counts = lookup.key_counts(df, {0: F.col("k")})
    assert [tuple(r) for r in lookup.hot_keys(counts, [0])[0].collect()] == [("hot",)]
    # Broadcast as it is, broadcast after the cut to occurring keys, shuffled.
    small, cut, large = look_up(df, looks()), look_up(df, looks(), 600), look_up(df, looks(), 0)
    assert "_salt" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert small.count() == cut.count() == large.count() == 3000
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str) \
        == sorted(map(tuple, cut.collect()), key=str)
    assert small.filter("v is not null").count() == 1000 + len(range(2, 1500, 3))


def test_tables_looked_up_together_share_the_bound_of_broadcasts(spark):
    # The driver holds all of them at once: tables that are small one by one were too much together.
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("k"))
    table = lambda i, n: spark.range(n).select(F.col("id").cast("string").alias("key"), (F.col("id") * i).alias(f"v{i}"))
    looks = lambda: [Lookup(F.col("k"), table(i, n)) for i, n in enumerate((900, 400, 500, 950, 30))]
    plan = lambda got: got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    broadcast = lambda got: [x for x in plan(got) if "_table_key" in x and "(strategy=broadcast)" in x]
    together, apart = look_up(df, looks(), 1000), look_up(df, looks(), 10_000)
    assert len(broadcast(apart)) == 5
    # 30, 400 and 500 rows, on both sides of a union; what is left of the bound does for neither of the others.
    assert len(broadcast(together)) == 6 and not any("_salt" in x for x in broadcast(together))
    assert sorted(map(tuple, together.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)
    assert together.filter("v3 IS NOT NULL").count() == 950 and together.count() == 3000


def test_large_address_sets_stay_out_of_the_plan_text(spark):
    table = spark.range(3000).select(F.lit("all").alias("scope"), F.lit("ip").alias("kind"), F.lit("src").alias("direction"),
                                     F.concat(F.lit("10.1."), (F.col("id") / 256).cast("int"), F.lit("."), F.col("id") % 256).alias("value"))
    book = RuleBook.load(table)
    assert list(book.tables) == [("ip", "src")] and not book.inline
    df = book.attach(packets(spark, [packet(0, src_ip="10.1.0.0"), packet(1, src_ip="10.0.0.0"), packet(2, src_ip="10.1.11.183")]))
    got = df.filter(~book.hit("ip", "src")).collect()
    assert [r["packet_id"] for r in got] == [1]
    assert timedelta(0) == got[0]["ts"] - START


@pytest.mark.parametrize("inline_rows", [0, 100_000])
def test_numbers_are_bits(spark, inline_rows):
    random.seed(9)
    edges = [0, 1, 63, 64, 32_767, 32_768, 65_535]
    ports = sorted({*edges, *random.sample(range(65_536), 3000)})
    masks = [0, 255, 511, 65_535]
    table = rules(spark, *[("all", "port", "src", str(p)) for p in ports], *[("level:1", "port", "dst", str(p)) for p in edges],
                  *[("node:1", "flags", None, str(m)) for m in masks], ("all", "port", "src", "65536"), ("all", "flags", None, "-1"))
    book = RuleBook.load(table, inline_rows=inline_rows)
    assert not book.tables
    asked = sorted({*edges, *(p + d for p in ports[:500] for d in (-1, 0, 1)), -1, 70_000})
    rows = [packet(i, src_port=p, dst_port=p, flag_mask=p, node_id=1) for i, p in enumerate(asked)] + [packet(9999, src_port=None, flag_mask=None)]
    got = book.add(packets(spark, rows), src=lambda b: b.hit("port", "src"), low=lambda b: b.hit("port", "dst", 0),
                   high=lambda b: b.hit("port", "dst", 1), flags=lambda b: b.hit("flags")).collect()
    for r in got:
        p = r["src_port"]
        assert (r["src"], r["low"], r["high"], r["flags"]) == (p in ports, False, r["dst_port"] in edges, r["flag_mask"] in masks)
    assert sorted(r["value"] for r in rejected_rules(table).collect()) == ["-1", "65536"]


def test_bloom_filter(spark):
    keys = spark.range(50_000).select(F.concat(F.lit("10.0.0."), "id").alias("key"))
    words = bits.bloom_words(50_000)
    passed = lambda df: df.filter(bits.might_be_in(F.col("key"), bits.bloom_filter(keys, "key", words).scalar(), words)).count()
    assert passed(keys) == 50_000
    others = spark.range(200_000).select(F.concat(F.lit("10.0.1."), "id").alias("key"))
    assert passed(others) < 0.02 * 200_000
    assert passed(spark.range(10).select(F.lit(None).cast("string").alias("key"))) == 0
    assert bits.bloom_words(0) == 1 and bits.bloom_words(1 << 40) == bits.BLOOM_WORDS


def test_only_possible_hits_are_shuffled(spark):
    table = spark.range(20_000).select(F.concat(F.lit("10.0.0."), "id").alias("key"), F.col("id").alias("v"))
    other = spark.range(100).select((F.col("id") * 2).cast("string").alias("key"), F.col("id").alias("w"))
    df = spark.range(100_000).select("id", F.when(F.col("id") % 1000 == 0, F.concat(F.lit("10.0.0."), F.col("id") % 30_000))
                                     .when(F.col("id") % 7 > 0, F.concat(F.lit("192.168."), "id")).alias("k"))
    got = look_up(df, [Lookup(F.col("k"), table, rows=1 << 30), Lookup((F.col("id") % 200).cast("string"), other)], 10_000)
    want = df.withColumns({"v": F.when(F.col("k").startswith("10.") & (F.substring_index("k", ".", -1).cast("int") < 20_000),
                                       F.substring_index("k", ".", -1).cast("long")),
                           "w": F.when(F.col("id") % 2 == 0, F.expr("(id % 200) div 2"))})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    shuffled = look_up(df, [Lookup(F.col("k"), table)], 0)
    assert sorted(map(tuple, shuffled.collect()), key=str) == sorted(map(tuple, want.drop("w").collect()), key=str)
    # One side of the union has no exchange: packets without a possible match go by.
    plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Join ") >= 1 and plan.split("\n")[-1].count("Join") == 0


SIGNATURES = {
    r"attack \d+ .*": "attack ", r"(a|b)longer text?": "longer tex", r"x|attack": "", r"(?i)attack": "", r"\Qattack\E": "", r"att+ack": "att",
    r"[abc]def\.ghi[^]x]*": "def.ghi", r"ab{0,2}cdef": "cdef", r"\x41tack\u0042 after": " after", r"((in)(ner)) out(er)*": " out", r"\p{L}word\pLx": "word",
    r"a\|b\\c": r"a|b\c", r"end$": "end", r"(?=look)ahead": "ahead", r"a+b": "a", r"": "", r"[\]]after": "after", r"(\))closed": "closed",
}


def test_required_text():
    for pattern, text in SIGNATURES.items():
        assert signatures.required_text(pattern) == text, pattern


@pytest.mark.parametrize("mode", ["full", "find"])
def test_signature_index(spark, mode):
    random.seed(3)
    parts = ["attack", "longer tex", "def.ghi", " after", "word", "ahead", "a|b\\c", "x", "end", "\n", "αβγδε", "closed", "inner outer", "12"]
    payloads = ["".join(random.choice(parts) for _ in range(random.randint(1, 5))) for _ in range(300)] + [None, "", "attack 12 now", "alonger text"]
    patterns = [*SIGNATURES, "αβγ.ε.*", "attack", ".*word.*", "(x)\\1", "12*"]
    df = packets(spark, [packet(i, payload=p) for i, p in enumerate(payloads)])
    index = signatures.signature_index(spark.createDataFrame([(p,) for p in patterns], "value string"))
    got = {(r["packet_id"], r["_signature"]) for r in signatures.signature_matches(df, index, mode).collect()}
    want = {(r["packet_id"], p) for p in patterns
            for r in df.filter(F.col("payload").rlike(signatures.signature(p, mode))).select("packet_id").collect()}
    assert got == want and len(want) > 100


def test_wide_signature_tables_are_not_broadcast(spark, monkeypatch):
    # Rows of signatures are wide: what is bounded as keys are would come to the driver as hundreds of MB.
    bounds = []
    seen = lambda df, lookups, rows=None: bounds.append(rows) or look_up(df, lookups, rows)
    monkeypatch.setattr(rules_module, "look_up", seen)
    monkeypatch.setattr(signatures, "look_up", seen)
    table = spark.range(40).selectExpr("'all' AS scope", "'pattern' AS kind", "CAST(NULL AS STRING) AS direction",
                                       "concat('signature ', 1000 + id) AS value")
    df = spark.createDataFrame([(i, 0, f"signature {1000 + i}", "TCP") for i in range(60)], "packet_id long, node_id int, payload string, proto string")
    book = RuleBook.load(table, inline_signatures=0, broadcast_rows=80)
    got = book.add(df, ok=lambda b: checks.payload_ok(b)).filter("ok").select("packet_id").collect()
    assert sorted(r[0] for r in got) == list(range(40, 60))
    assert bounds.count(80 // signatures.SIGNATURE_WIDTH) == 2


def test_a_hundred_thousand_signatures(spark):
    made = spark.range(100_000).select(F.lit("all").alias("scope"), F.lit("pattern").alias("kind"), F.lit(None).cast("string").alias("direction"),
                                       F.concat(F.lit("attack [a-z]+ "), F.col("id"), F.lit(" .*")).alias("value"))
    odd = rules(spark, ("all", "pattern", None, "("), ("all", "pattern", None, "a)|(b"), ("node:2", "pattern", None, "only (here|there)"))
    book = RuleBook.load(made.unionByName(odd))
    rows = [packet(0, payload="attack on 99999 x"), packet(1, payload="attack on 100000 x"), packet(2, payload="attack 7 x"), packet(3, payload=None),
            packet(4, payload="only here", node_id=2), packet(5, payload="only here", node_id=1), packet(6, payload="a"), packet(None, payload="attack x 5 y")]
    df = packets(spark, rows)
    assert {r["packet_id"] for r in screen(df, "dpi", book).filter("NOT verdict").collect()} == {0, 4, None}
    assert {r["value"] for r in rejected_rules(made.unionByName(odd)).collect()} == {"(", "a)|(b"}


def test_tables_keyed_by_ids_of_rows_do_not_come_to_the_driver(spark, monkeypatch):
    filters = []
    monkeypatch.setattr(lookup, "bloom_filter", lambda *args: filters.append(args) or bits.bloom_filter(*args))
    df = spark.range(2000).select("id", F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("k")).union(spark.range(5).select("id", F.lit("7")))
    table = spark.range(0, 2000, 3).select(F.col("id").cast("string").alias("key"), F.lit(True).alias("found"))
    small = spark.range(4).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v"))
    looks = lambda: [Lookup(F.col("k"), table, spread=True), Lookup((F.col("id") % 5).cast("string"), small)]
    got, want = look_up(df, looks(), 1000), look_up(df, looks())
    hints = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "(strategy=broadcast)" in x]
    assert len(hints) == 1 and not filters
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 2005 and got.filter("found").count() == 500


def test_payloads_are_read_once_for_the_signatures_of_all_levels(spark, monkeypatch):
    read = []
    monkeypatch.setattr(rules_module, "signature_matches", lambda *args: read.append(args) or signatures.signature_matches(*args))
    log = rule_log(spark, (1, 0, "all", "add", "pattern", None, "bad.*"), (2, 0, "level:1", "add", "pattern", None, ".*worse"),
                   (3, 0, "node:2", "add", "pattern", None, "odd"), (4, 10, "level:0", "remove", "pattern", None, "bad.*"),
                   (5, 20, "all", "reset", None, None, None))
    rows = [packet(i, s, node_id=n, payload=p) for i, (s, n, p) in enumerate([
        (1, 1, "bad one"), (1, 1, "worse"), (1, 1, "odd"), (1, 2, "odd"), (11, 1, "bad one"), (11, 2, "bad and worse"), (21, 1, "bad one")])]
    got = cascade_as_of(packets(spark, rows), log, nodes(spark, (1, 0), (2, 0)), {0: "dpi", 1: "dpi", 2: "dpi"}).collect()
    assert {r["packet_id"]: r["dropped_at"] for r in got} == {0: 0, 1: 1, 2: None, 3: 0, 4: 1, 5: 1, 6: None}
    assert len(read) == 1


def test_cascade_under_changing_profiles(spark):
    log = rule_log(spark, (1, -5, "all", "add", "port", "src", "5"), (2, -4, "level:1", "add", "pattern", None, "bad"),
                   (3, 10, "level:1", "profile", None, None, "basic"), (4, 20, "node:2", "profile", None, None, "3"),
                   (5, 21, "node:2", "add", "pattern", None, "bad"), (6, 30, "level:0", "profile", None, None, "none"),
                   (7, 40, "all", "profile", None, None, "0"))
    case = lambda i, s, **f: packet(i, s, **{"node_id": 1, "src_port": 6, **f})
    rows = [case(0, 1, src_port=5), case(1, 1, payload="bad"), case(2, 1), case(3, 1, proto="ICMP", src_port=5),
            # Level 1 runs the basic profile now and its rules are gone, also those for all.
            case(4, 11, payload="bad"), case(5, 11, src_port=5),
            # All levels of node 2 run the full profile, whose first level knows the signature.
            case(6, 22, node_id=2, payload="bad"), case(7, 22, node_id=2, src_port=5), case(8, 22, node_id=2, proto="ICMP"),
            case(9, 22, payload="bad"), case(10, 22, src_port=5),
            # An unknown profile wipes the rules of level 0 and leaves its profile.
            case(11, 31, src_port=5), case(12, 31, node_id=2, proto="ICMP"),
            # Nothing is checked any more.
            case(13, 41, node_id=2, proto="ICMP"), case(14, 41, src_port=5)]
    got = cascade_as_of(packets(spark, rows), log, nodes(spark, (1, 0), (2, 1)))
    assert {r["packet_id"]: r["dropped_at"] for r in got.collect() if r["dropped_at"] is not None} == {
        0: 0, 1: 1, 5: 0, 6: 0, 8: 0, 10: 0, 12: 0}
    assert got.columns == packets(spark, rows).columns + ["dropped_at"]
