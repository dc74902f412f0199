"""Repair of conversations against a search of all cheapest edits by brute force."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from edge import rows
from pyspark.sql import functions as F

from flowguard.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"


def after_damage(source):
    """The rows of every conversation, in order, after damage."""
    out = defaultdict(list)
    for conv, turn, role, text in source:
        out[conv]
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults_of(own):
    seen = set()
    for _, role, text in own:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        yield fault


def cheapest(own, faults):
    """(cost, audit, repaired rows), the least of all by cost, then audit: a plain table of best edits so far."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def better(table, state, cost, audit, kept):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, kept)

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, kept) in list(table.items()):
                for r in after[state]:
                    if r in full:
                        better(table, r, cost + 3, audit + "I", (*kept, (full[r], "")))
        return table

    for (_, role, text), fault in zip(own, faults):
        now = {}
        for state, (cost, audit, kept) in inserted(best).items():
            better(now, state, cost + 4, audit + "D", kept)
            if fault in ("blank", "duplicate"):
                continue
            fee = 3 if fault else 0
            if role[:1] in after[state]:
                better(now, role[:1], cost + fee, audit + "K", (*kept, (role, text)))
            for r in after[state]:
                if r in full:
                    better(now, r, cost + fee + 3, audit + "R", (*kept, (full[r], text)))
        best = now
    return min(v for state, v in inserted(best).items() if state in ("", "a"))


def repaired(source):
    for conv, own in after_damage(source).items():
        turns = {t for t, *_ in own if t is not None}
        faults = list(faults_of(own))
        pairs = [x[1][:1] + y[1][:1] for x, y in itertools.pairwise(own)]
        cost, audit, kept = cheapest(own, faults)
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
               sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
               hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def conversations(folder="/root/testdata/sf0.01"):
    return duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()


def odd_turns():
    import random
    rnd = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "union", "User"]
    texts = ["Yes.", "No", "", " \n", None, "What is it? ", " ", "x" * 300_000 + "!", "Yes."]
    out = [(rnd.choice([0, 1, 2, 3, None, 7]), rnd.choice([None, *range(30)]), rnd.choice(roles[:3] if rnd.random() < 0.7 else roles),
            rnd.choice(texts)) for _ in range(400)]
    out += [(50, 1, "user", "Same."), (50, 1, "user", "Same.")] * 20 + [(51 + i, 0, "tool", None) for i in range(30)]
    # One conversation that needs several chunks, with faults of all kinds.
    out += [(99, i, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["A.", f"text {i}.", f"text {i}", ""]))
            for i in range(700)]
    return out


def test_auction_finds_the_cheapest_edits():
    for n in range(1, 5):
        for symbols in itertools.product(range(12), repeat=n):
            price = dialogue.prices(list(symbols), None)
            roles = [("system", "user", "assistant", "tool")[s // 3] for s in symbols]
            faults = [("", "truncated", "blank")[s % 3] for s in symbols]
            cost, audit, _ = cheapest([(0, r, "") for r in roles], faults)
            kept, tail, _ = dialogue.trace(list(symbols), price, dialogue.START, True)
            assert (price[0], "".join(x[3] for x in kept) + tail[1]) == (cost, audit)


@pytest.mark.parametrize("chunk", [dialogue.CHUNK, 3])
def test_repair(spark, chunk):
    source = conversations() + [(None if c is None else c + 1000, *rest) for c, *rest in odd_turns()]
    df = spark.createDataFrame(source, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("key", "kind", "chunk", "audit", "idx")})
    assert rows(dialogue.repair(df, chunk=chunk)) == sorted(repaired(source), key=repr)


def test_empty_table(spark):
    assert rows(dialogue.repair(spark.createDataFrame([], SCHEMA))) == []
