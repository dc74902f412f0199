"""Repairs the structure of damaged conversations at least cost.

A repaired conversation has at most one system turn first, and then user and
assistant turns in pairs. Every row may be kept, given another role or deleted,
and empty turns may be inserted anywhere. The edits are arcs of a lattice over
(row, state), and the cheapest are found by an auction for shortest paths: every
node has a price, a path is extended over arcs that the prices make tight and
contracted where it must raise a price. The prices that remain are the exact
distances, so that the arcs which they leave tight are those of all cheapest
repairs; of these the least in ASCII order is traced.

Conversations are cut into chunks of rows, so that one of any length is shared
by many tasks. What a chunk costs between any two states is found by the same
auction; a fold over the few numbers per chunk then gives the prices at its end.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..session import materialise
from .common import broadcast_if_small, per_worker

# Rows of one chunk, and solutions of short chunks that a worker remembers.
CHUNK = 4096
SHORT, REMEMBERED = 64, 50_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# States: nothing yet, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# Nodes that cannot reach the end they are asked for.
NEVER = 1 << 40

SPACES = r"\x20\x09-\x0D"
# What stands for a row: its role (s, u, a, other) and its fault (none, truncated, to be deleted).
SYMBOLS = "ABCDEFGHIJKL"
LEGAL = {(0, 1), (1, 2), (2, 1)}

FOLLOWING = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}


def _arcs(symbol: int, state: int) -> tuple:
    """(letter, cost, rows consumed, state after, new role) of all edits of a row, in the order of their letters."""
    role, fault = divmod(symbol, 3)
    after, name = FOLLOWING[state]
    out = [("D", DELETE, 1, state, ""), ("I", INSERT, 0, after, name)]
    if fault < 2:
        fee = TRUNCATED * fault
        if role == 0 and state == START:
            out.append(("K", KEEP + fee, 1, SYSTEM, ""))
        elif role in (1, 2) and role + 1 == after:
            out.append(("K", KEEP + fee, 1, after, ""))
        out.append(("R", REROLE + fee, 1, after, name))
    return tuple(out)


ARCS = tuple(tuple(_arcs(symbol, state) for state in STATES) for symbol in range(len(SYMBOLS)))
CLOSING = tuple((("I", INSERT, 0, *FOLLOWING[state]),) for state in STATES)


def prices(symbols: list[int], ends: list[int] | None, states=STATES) -> list[int]:
    """The cost from every (row, state) to the end of a chunk, by auction.

    ``ends`` are the prices after the last row; without them the conversation
    ends there. Nodes of states that are not in ``states`` reach no end. Every
    node is the origin of one path in turn, from the last to the first; the path
    is complete as soon as it meets a node whose price is settled.
    """
    n = len(symbols)
    arcs = [ARCS[s] for s in symbols] + [CLOSING]
    price, settled = [0] * (4 * n + 5), bytearray(4 * n + 5)
    end = 4 * n + 4
    settled[end] = 1
    for q in STATES:
        if q not in states:
            price[q:end:4] = [NEVER] * (n + 1)
            settled[q:end:4] = b"\1" * (n + 1)
    if ends is not None:
        price[4 * n:end], settled[4 * n:end] = ends, b"\1" * 4
    for origin in range(end - 1, -1, -1):
        if settled[origin]:
            continue
        path = [origin]
        while True:
            node = path[-1]
            i, q = node >> 2, node & 3
            best, to = (0, end) if i == n and q in (START, ASSISTANT) else (NEVER, -1)
            for _, cost, rows, after, _ in arcs[i][q]:
                j = 4 * (i + rows) + after
                if cost + price[j] < best:
                    best, to = cost + price[j], j
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to < 0 or settled[to]:
                for node in path:
                    settled[node] = 1
                break
            else:
                path.append(to)
    return price


def trace(symbols: list[int], price: list[int], state: int, closes: bool):
    """Follow tight arcs, the least letter first.

    Returns the kept rows as (row, roles inserted before it, new role or '',
    letters up to it), what follows the last as (roles, letters), and the last state.
    """
    n, i, out, letters, before = len(symbols), 0, [], [], []
    while i < n or closes and state not in (START, ASSISTANT):
        here = price[4 * i + state]
        for letter, cost, rows, after, role in (ARCS[symbols[i]] if i < n else CLOSING)[state]:
            if here == cost + price[4 * (i + rows) + after]:
                break
        else:
            raise AssertionError("no tight arc")
        letters.append(letter)
        if letter == "I":
            before.append(role)
        elif letter != "D":
            out.append((i, before, role, "".join(letters)))
            letters, before = [], []
        i, state = i + rows, after
    return out, (before, "".join(letters)), state


def illegal_pairs(symbols: list[int]) -> int:
    roles = [s // 3 for s in symbols]
    return sum(pair not in LEGAL for pair in zip(roles, roles[1:]))


def _numbers(symbols: str) -> list[int]:
    return [ord(c) - 65 for c in symbols]


def crossing(symbols: str) -> list[int]:
    """The cost of a chunk from each state to each, as 16 numbers."""
    numbers, out = _numbers(symbols), [NEVER] * 16
    for exit_ in STATES:
        # Nothing leads back to the start, nor to a system turn once another role was written.
        found = prices(numbers, [0 if q == exit_ else NEVER for q in STATES], range(exit_ + 1) if exit_ < USER else STATES)
        for q in STATES:
            out[4 * q + exit_] = min(found[q], NEVER)
    return out


def _as_arrow(run, *names):
    """A function for mapInArrow from one that takes and yields tuples of column values."""
    def rows_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), names)], names=[n for n, _ in names])

    def wrapped(batches):
        rows, weight = [], 0
        for row in run(rows_of(batches)):
            rows.append(row)
            weight += 1 + sum(len(v) for v in row if isinstance(v, list))
            if weight >= 10_000:
                yield batch_of(rows)
                rows, weight = [], 0
        if rows:
            yield batch_of(rows)
    return wrapped


def _symbol(role: Column, deleted: Column, truncated: Column) -> Column:
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 3).when(initial == "a", 6).otherwise(9)
    fault = F.when(deleted, 2).when(truncated, 1).otherwise(0)
    return F.substring(F.lit(SYMBOLS), place + fault + 1, F.lit(1))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """The rows after damage: (key, known, turn, role, text, copies).

    ``key`` names the conversation, NULL included; ``known`` is 0 for a NULL
    turn. A NULL role or text is one space, and so is a NULL number in the hash
    that decides on the damage. ``copies`` is 2 where a row is repeated.
    """
    conv, turn = F.col(conv_col).cast("string"), F.col(turn_col).cast("long")
    space = F.lit(" ")
    h = F.crc32(F.concat_ws(":", F.coalesce(conv, space), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    text = F.coalesce(F.col(text_col), space)
    return turns.select(
        _key(conv).alias("key"), turn.isNotNull().cast("int").alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.when(h == 4, "user").otherwise(F.coalesce(F.col(role_col), space)).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 3, 2).otherwise(1).alias("copies"), h.alias("_h")).filter("_h <> 0").drop("_h")


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv), F.lit(""))


# Rows of one conversation are ordered by turn; those of one turn by role and text,
# of which 32 characters and the digest stand for the rest.
ORDER = ["known", "turn", "role", "head", "digest"]


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.substring("text", 1, 32)).withColumn("digest", F.unhex(F.sha2("text", 256)))


def chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Damaged conversations as a row per chunk: key, chunk, last, symbols, own (sort keys of its rows), counts of faults."""
    facts = _placed(rows).select(
        "key", *ORDER, "copies", (~F.col("text").rlike(f"[^{SPACES}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")).alias("truncated"))
    copies = facts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    # Equal rows are spread by a last key; which of them comes first makes no difference.
    placed = number_rows(copies.withColumn("_any", F.rand(7)), ["key"], [*ORDER, "_any"])
    repeated = placed.filter("not blank").groupBy("key", "role", "digest") \
        .agg(F.min("idx").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = broadcast_if_small(materialise(repeated, "repeated"), 160)
    marked = placed.join(repeated, ["key", "role", "digest"], "left") \
        .withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("idx") > F.col("first"), F.lit(False))) \
        .withColumn("truncated", F.col("truncated") & ~F.col("blank") & ~F.col("duplicate"))
    row = F.struct("idx", _symbol(F.col("role"), F.col("blank") | F.col("duplicate"), F.col("truncated")).alias("symbol"),
                   *ORDER)
    made = marked.groupBy("key", (F.floor(F.col("idx") / chunk)).alias("chunk")).agg(
        F.array_sort(F.collect_list(row)).alias("own"), F.max("total").alias("total"),
        *(F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")))
    return materialise(made.select(
        "key", "chunk", ((F.col("chunk") + 1) * chunk >= F.col("total")).alias("last"),
        F.array_join(F.transform("own", lambda r: r["symbol"]), "").alias("symbols"),
        F.transform("own", lambda r: r.dropFields("idx", "symbol")).alias("own"),
        "blank", "duplicate", "truncated"), "chunks")


def _states_between(made: DataFrame) -> DataFrame:
    """For chunks of conversations that have several: key, chunk, prices at its end, state at its begin, illegal joint after it."""
    long = made.filter("chunk > 0 or not last").select("key", "chunk", "last", "symbols")
    four = pa.list_(pa.int64())

    def cross(rows):
        for key, chunk, last, symbols in rows:
            yield key, chunk, last, symbols[0], symbols[-1], prices(_numbers(symbols), None)[:4] if last else crossing(symbols)

    def backwards(rows):
        now, begin, following = None, None, None
        for key, chunk, last, first, final, cost in rows:
            if key != now:
                now, begin, following = key, None, None
            joint = following is not None and illegal_pairs(_numbers(final + following))
            yield key, chunk, begin, int(joint)
            begin = cost if last else [min(cost[4 * q + e] + begin[e] for e in STATES) for q in STATES]
            following = first

    def exits(rows):
        for key, chunk, last, symbols, ends in rows:
            numbers = _numbers(symbols)
            price = prices(numbers, ends)
            yield key, chunk, [trace(numbers, price, q, False)[2] if not last else q for q in STATES]

    def forwards(rows):
        now, state = None, START
        for key, chunk, exit_ in rows:
            if key != now:
                now, state = key, START
            yield key, chunk, state
            state = exit_[state]

    name, number = ("key", pa.string()), ("chunk", pa.int64())
    costs = long.mapInArrow(_as_arrow(cross, name, number, ("last", pa.bool_()), ("first", pa.string()),
                                      ("final", pa.string()), ("cost", four)),
                            "key string, chunk long, last boolean, first string, final string, cost array<long>")
    ends = costs.repartition("key").sortWithinPartitions("key", F.desc("chunk")) \
        .mapInArrow(_as_arrow(backwards, name, number, ("ends", four), ("joint", pa.int32())),
                    "key string, chunk long, ends array<long>, joint int")
    ends = materialise(ends, "ends")
    maps = long.join(ends, ["key", "chunk"]).select("key", "chunk", "last", "symbols", "ends") \
        .mapInArrow(_as_arrow(exits, name, number, ("exits", four)), "key string, chunk long, exits array<long>")
    begins = maps.repartition("key").sortWithinPartitions("key", "chunk") \
        .mapInArrow(_as_arrow(forwards, name, number, ("state", pa.int32())), "key string, chunk long, state int")
    return materialise(ends.join(begins, ["key", "chunk"]), "states")


def _solved(rows: Iterator[tuple]):
    """The edits of each chunk."""
    known = per_worker("dialogue", dict)
    for key, chunk, last, symbols, ends, state in rows:
        question = (symbols, state) if len(symbols) <= SHORT and ends is None else None
        answer = known.get(question) if question else None
        if answer is None:
            numbers = _numbers(symbols)
            price = prices(numbers, ends)
            kept, tail, _ = trace(numbers, price, state, last)
            answer = kept, tail, price[START], illegal_pairs(numbers)
            if question:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[question] = answer
        kept, (after, letters), cost, illegal = answer
        edits = [{"row": i, "kind": 0, "before": before, "new_role": role, "letters": text} for i, before, role, text in kept]
        edits.append({"row": len(symbols) - 1, "kind": 2, "before": after, "new_role": "", "letters": letters})
        yield key, chunk, edits, cost if chunk == 0 else 0, illegal


def _written(rows: Iterator[tuple]):
    """The audit and the digest of every repaired conversation, whose rows and edits come in order."""
    now, letters, digest, first, waiting = None, [], None, True, None

    def write(role, text):
        nonlocal first
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False

    for key, kind, place, before, new_role, edit, text in rows:
        if key != now:
            if now is not None:
                yield now, "".join(letters), digest.hexdigest()
            now, letters, digest, first, waiting = key, [], hashlib.sha256(), True, None
        if kind == 1:
            # The text of an edit follows it; copies of that text, and texts without an edit, are deleted.
            if waiting and waiting[0] == place:
                write(waiting[1] or place["role"], text)
                waiting = None
            continue
        letters.append(edit)
        for role in before:
            write(role, "")
        if kind == 0:
            waiting = (place, new_role)
    if now is not None:
        yield now, "".join(letters), digest.hexdigest()


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Damage conversations by a hash, count their faults and repair them.

    Returns one row per value of ``conv_col``, NULL included: ``conv_col``, gaps,
    blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Rows
    are taken by turn, NULL turns first; rows of one turn by role, then text.
    NULL roles and texts are one space. A conversation of which no row is left
    has zeros, an empty audit and the digest of an empty text. Repeated rows are
    duplicates; an empty table gives no rows; texts and conversations may have
    any length. Other columns are not read.

    Counting, sorting and solving are shared by chunks of ``chunk`` rows. Only
    the SHA-256 of a conversation, which is sequential by definition, streams
    its rows through one task, in constant memory but for the audit itself.
    """
    rows = damaged(turns, conv_col, turn_col, role_col, text_col)
    made = chunks(rows, chunk)
    between = broadcast_if_small(_states_between(made), 128)
    edit_type = pa.list_(pa.struct([("row", pa.int32()), ("kind", pa.int32()), ("before", pa.list_(pa.string())),
                                    ("new_role", pa.string()), ("letters", pa.string())]))
    solved = made.select("key", "chunk", "last", "symbols").join(between, ["key", "chunk"], "left").select(
        "key", "chunk", "last", "symbols", "ends", F.coalesce("state", F.lit(START)).alias("state"))
    solved = materialise(solved.mapInArrow(
        _as_arrow(_solved, ("key", pa.string()), ("chunk", pa.int64()), ("edits", edit_type), ("cost", pa.int64()),
                  ("illegal", pa.int64())),
        "key string, chunk long, edits array<struct<row:int,kind:int,before:array<string>,new_role:string,letters:string>>, "
        "cost long, illegal long"), "solved")

    edits = solved.join(made.select("key", "chunk", "own"), ["key", "chunk"]) \
        .select("key", "chunk", "own", F.explode("edits").alias("e")) \
        .select("key", F.element_at("own", F.col("e.row") + 1).alias("place"), "chunk", "e.*") \
        .select("key", "place.*", "kind", "chunk", "before", "new_role", "letters", F.lit(None).cast("string").alias("text"))
    texts = _placed(rows).filter(F.col("text").rlike(f"[^{SPACES}]")).select(
        "key", *ORDER, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("chunk"),
        F.lit(None).cast("array<string>").alias("before"), F.lit(None).cast("string").alias("new_role"),
        F.lit(None).cast("string").alias("letters"), "text")
    written = edits.unionByName(texts).repartition("key").sortWithinPartitions("key", *ORDER, "kind", "chunk") \
        .select("key", "kind", F.struct(*ORDER).alias("place"), "before", "new_role", "letters", "text") \
        .mapInArrow(_as_arrow(_written, ("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())),
                    "key string, audit string, repaired_sha256 string")

    spans = rows.filter("known = 1").groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    faults = made.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    costs = solved.groupBy("key").agg(F.sum("illegal").alias("inside"), F.sum("cost").alias("cost"))
    joints = between.groupBy("key").agg(F.sum("joint").alias("joints"))
    zero = lambda *names: (F.coalesce(*names, F.lit(0)).cast("long"))
    return turns.select(F.col(conv_col)).distinct().withColumn("key", _key(F.col(conv_col).cast("string"))) \
        .join(spans, "key", "left").join(faults, "key", "left").join(costs, "key", "left").join(joints, "key", "left") \
        .join(written, "key", "left").select(
            conv_col, *(zero(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")),
            (zero("inside") + zero("joints")).alias("illegal"), zero("cost").alias("cost"),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
