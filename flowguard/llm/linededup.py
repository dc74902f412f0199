"""Fuzzy deduplication of lines.

Lines are normalised to their words and get a 64-bit SimHash. Lines whose
hashes differ in at most three bits share two of five blocks of bits. Hashes
meet in one task by one block and there by a second one; only links that join
hashes to families leave the task, never all pairs. The lines of a family are
verified by edit similarity, however many they are.
Of each connected group one occurrence stays.
"""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import PowerSums, WordHasher, broadcast_if_small, components, mix, per_worker, ragged
from .licenses import WORD
from .neardup import joined

SIMILARITY = 0.8
# Lines with fewer characters than this always stay.
LEAST_CHARS = 16
MOST_BITS = 3
# Words of fewer bytes have no part in the SimHash of a line that has longer ones.
TELLING_BYTES = 4
# Fixed by MOST_BITS: with five blocks, three differing bits leave two untouched.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
# SimHashes that one task compares, and those of one key up to which all pairs are looked at side by side.
TASK_HASHES = 1 << 15
BUCKET = 16
# Texts that are held as Python values at a time.
PART = 256


def telling(words: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each run that are long enough to tell lines apart, or all of a run that has none.

    The shortest words stand in every line. Their votes would give lines that
    have nothing else in common the same bits.
    """
    long = sizes >= TELLING_BYTES
    before = np.append(0, np.cumsum(long))
    none = before[bounds[1:]] == before[bounds[:-1]]
    chosen = long | np.repeat(none, np.diff(bounds))
    return words[chosen], np.append(0, np.cumsum(chosen))[bounds]


def simhashes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The SimHash of each run words[bounds[i]:bounds[i + 1]] of word hashes."""
    size = np.diff(bounds)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    # Eight bits of every word at a time, one to a byte; a byte holds the count of up to 255 words.
    parts = -(-size[full] // 255)
    starts = ragged(np.zeros(len(full), np.int64), parts) * 255 + np.repeat(bounds[:-1][full], parts)
    first = np.cumsum(parts) - parts
    half = size[full]
    for bit in range(8):
        lanes = (words >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts, first, axis=0, dtype=np.int32)
        majority = np.ascontiguousarray(2 * counts > half[:, None]).view(np.uint64).ravel()
        out[full] |= majority << np.uint64(bit)
    return out


def block_values(simhash):
    """The first four of the five blocks of a SimHash column: two hashes that share two blocks share one of these."""
    return F.array(*(F.shiftrightunsigned(simhash, shift).bitwiseAND(F.lit((1 << size) - 1)).cast("int")
                     for shift, size in BLOCKS[:-1]))


def _within(x, y):
    return np.bitwise_count(x ^ y) <= MOST_BITS


def _near(own: np.ndarray, mask: np.uint64):
    """Links (x, y) between hashes that agree under ``mask`` which join whatever all their near pairs join."""
    key = own & mask
    order = np.argsort(key, kind="stable")
    own, key = own[order], key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat((sizes > 1) & (sizes <= BUCKET), sizes)
    few, key = own[small], key[small]
    for apart in range(1, BUCKET):
        at = np.flatnonzero(key[:-apart] == key[apart:])
        if not len(at):
            break
        at = at[_within(few[at], few[at + apart])]
        yield few[at], few[at + apart]
    for run in np.flatnonzero(sizes > BUCKET):
        left, open_ = own[starts[run]:starts[run] + sizes[run]], []
        while len(left):
            if not open_:
                open_, left = [left[0]], left[1:]
            x = open_.pop()
            near = _within(left, x)
            if near.any():
                yield np.full(int(near.sum()), x), left[near]
                open_ += list(left[near])
                left = left[~near]


def _near_links(table):
    """A link for every two families of near hashes of a task that become one."""
    hashes, block = table["simhash"].to_numpy().view(np.uint64), table["block"].to_numpy()
    found = [(np.zeros(0, np.uint64),) * 2]
    for i, j in combinations(range(len(BLOCKS)), 2):
        mask = np.uint64(sum((1 << size) - 1 << shift for shift, size in (BLOCKS[i], BLOCKS[j])))
        found += _near(hashes[block == i], mask)
    x, y = (np.concatenate(side).view(np.int64) for side in zip(*found))
    root, a, b = {}, [], []

    def top(v):
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    for v, w in np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1).T.tolist():
        own, other = top(v), top(w)
        if own != other:
            root[other] = own
            a.append(v)
            b.append(w)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def families(hashes: DataFrame) -> DataFrame:
    """The hashes (simhash) of a stored table that near ones lead to others: (simhash, family).

    Four rows a hash are shuffled. Hashes that share a block are in one task,
    and few enough there, since a block has thousands of values.
    """
    tasks = max(1, -(-hashes.count() * (len(BLOCKS) - 1) // TASK_HASHES))
    dealt = hashes.select("simhash", F.posexplode(block_values(F.col("simhash"))).alias("block", "value")) \
        .select("simhash", "block", F.pmod(F.xxhash64("block", "value"), F.lit(tasks)).cast("int").alias("task"))
    links = materialise(dealt.groupBy("task").applyInArrow(_near_links, "a long, b long"), "links")
    return components(links).select(F.col("id").alias("simhash"), F.col("component").alias("family"))


def normalised(line: str) -> str:
    """The words of a line in lower case."""
    return " ".join(WORD.findall(line.lower()))


def edit_distance(a: str, b: str) -> int:
    """Character edits between two lines, all cells of a row at once as bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    size, peq = len(a), {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size
    for c in b:
        equal = peq.get(c, 0)
        x = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        left_up = down | (~(diagonal | up) & full)
        left_down = up & diagonal
        if left_up & top:
            distance += 1
        elif left_down & top:
            distance -= 1
        left_up = (left_up << 1 | 1) & full
        left_down = left_down << 1 & full
        up = left_down | (~(x | left_up) & full)
        down = left_up & x
    return distance


def _same_until(a: str, b: str) -> int:
    """The length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether edits change at most 1 - ``least`` of the longer line."""
    most = max(len(a), len(b))
    allowed = (1 - least) * most + 1e-9
    if abs(len(a) - len(b)) > allowed:
        return False
    # What both lines begin and end with costs nothing; the rest never costs more than its length.
    begin = _same_until(a, b)
    a, b = a[begin:], b[begin:]
    end = _same_until(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    return max(len(a), len(b)) <= allowed or edit_distance(a, b) <= allowed


def _lines(batches):
    hasher, sums = per_worker("words", WordHasher), per_worker("line sums", lambda: PowerSums(1 << 16))
    for batch in batches:
        # Few texts at a time: a list of lines takes as much again as the texts.
        for at in range(0, len(batch), PART):
            part = batch.slice(at, PART)
            split = pc.split_pattern(part.column(1).cast(pa.large_string()).fill_null(""), "\n")
            flat = pc.utf8_lower(split.flatten())
            number = np.concatenate([np.arange(n) for n in split.value_lengths().to_numpy()])
            owner = pc.list_parent_indices(split).to_numpy()
            chars = pc.utf8_length(flat).to_numpy()
            for first, words, bounds, sizes in hasher.sized_texts(flat):
                rows = np.arange(first, first + len(bounds) - 1)
                hashed = mix(words)
                one = sums.hashes(words, bounds[:-1], bounds[1:])
                two = sums.hashes(hashed, bounds[:-1], bounds[1:])
                kept = np.flatnonzero((np.diff(bounds) > 0) & (chars[rows] >= LEAST_CHARS))
                own = pa.array(owner[rows[kept]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(2).take(own), pa.array(number[rows[kept]], pa.int32()),
                     pa.array(one[kept].view(np.int64)), pa.array(two[kept].view(np.int64)),
                     pa.array(simhashes(*telling(words, bounds, sizes))[kept].view(np.int64))],
                    names=["id", "key", "line", "h1", "h2", "simhash"])


def _texts(batches):
    """The normalised text of chosen lines of each document."""
    for batch in batches:
        for at in range(0, len(batch), PART):
            part = batch.slice(at, PART)
            names, texts = [], []
            for text, chosen in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                lines = text.split("\n")
                for x in chosen:
                    names.append(x["id"])
                    texts.append(normalised(lines[x["line"]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())], names=["id", "t"])


def _verify(least):
    def run(batches):
        for batch in batches:
            keep = [similar(a, b, least) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))
    return run


def _near_pairs(left, right):
    """Positions (i, j) of lines of two chunks, or of one, that are within few bits and in different components."""
    x, own = left["simhash"].to_numpy().view(np.uint64), left["component"].to_numpy()
    y, other = (x, own) if right is None else (right["simhash"].to_numpy().view(np.uint64), right["component"].to_numpy())
    return np.nonzero(_within(x[:, None], y[None, :]) & (own[:, None] != other[None, :]))


def _alike(least):
    """Links that join the components of two chunks as all their similar pairs would."""
    def run(left, right):
        i, j = _near_pairs(left, right)
        both = left if right is None else pa.concat_tables([left, right])
        if right is None:
            i, j = i[i < j], j[i < j]
        else:
            j = j + len(left)
        ids, texts, label = both["id"].to_pylist(), both["t"].to_pylist(), both["component"].to_numpy().copy()
        a, b = [], []
        for own in np.split(np.arange(len(i)), np.flatnonzero(i[1:] != i[:-1]) + 1) if len(i) else ():
            x, others = i[own[0]], j[own]
            others = others[label[others] != label[x]]
            while len(others):
                y = others[0]
                if similar(texts[x], texts[y], least):
                    a.append(ids[x])
                    b.append(ids[y])
                    label[label == label[y]] = label[x]
                others = others[1:]
                others = others[label[others] != label[x]]
        return a, b
    return run


def duplicate_lines(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The lines to drop: (id, key, lines), a row per text that loses some.

    ``key`` is xxhash64 of the text, which tells texts under one id apart;
    ``lines`` are the numbers of the lines, from 0.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    kind = plain.schema["id"].dataType.simpleString()
    lines = materialise(plain.mapInArrow(
        _lines, f"id {kind}, key long, line int, h1 long, h2 long, simhash long"), "lines")
    # Distinct lines with their first occurrence; copies are combined before the shuffle.
    place = F.struct("id", "key", "line")
    distinct = materialise(lines.groupBy("h1", "h2").agg(
        F.count("*").alias("times"), F.min(place).alias("first"), F.first("simhash").alias("simhash")), "distinct")
    near = materialise(families(materialise(distinct.select("simhash").distinct(), "hashes")), "families")
    grouped = distinct.select("h1", "simhash", "first").join(broadcast_if_small(near, 32), "simhash", "left") \
        .select(F.col("h1").alias("id"), "simhash", "first", F.coalesce("family", "simhash").alias("value"))
    least_of = grouped.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("id", "simhash")).alias("least")) \
        .filter("size > 1").select("value", "least")
    members = materialise(grouped.join(broadcast_if_small(materialise(least_of, "least"), 64), "value"), "members")

    # The texts of families with more than one line.
    chosen = members.groupBy("first.id", "first.key") \
        .agg(F.collect_list(F.struct("id", F.col("first.line").alias("line"))).alias("chosen"))
    chosen = broadcast_if_small(materialise(chosen, "chosen"), 256).alias("c")
    texts = materialise(plain.alias("d").join(chosen, F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.key") == F.col("c.key")))
                        .select("text", "chosen").mapInArrow(_texts, "id long, t string").dropDuplicates(["id"]), "texts")

    # Each line is compared with the first of its family, so that a group of copies is soon known; then all with all.
    star = members.filter((F.col("id") > F.col("least.id"))
                          & (F.bit_count(F.col("simhash").bitwiseXOR(F.col("least.simhash"))) <= MOST_BITS)) \
        .select(F.col("least.id").alias("a"), F.col("id").alias("b"))
    links = star.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a") \
        .join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b") \
        .select("a", "b", "ta", "tb").mapInArrow(_verify(least), "a long, b long")
    known = materialise(components(materialise(links, "verified")), "component")
    reached = joined(known, members.select("id", F.lit(0).alias("band"), "value", F.col("least.id").alias("first")),
                     members.select("id", "simhash").join(texts, "id"), _alike(least))

    # The group of every line that has a copy or a link, and the occurrence that stays. Tables that grow with the
    # input are left to Spark, which broadcasts only small ones.
    groups = distinct.join(broadcast_if_small(reached, 32).withColumnRenamed("id", "h1"), "h1", "left") \
        .filter("times > 1 OR component IS NOT NULL") \
        .select("h1", "h2", "times", "first", F.coalesce("component", "h1").alias("group"))
    groups = materialise(groups, "repeated")
    stays = groups.groupBy("group").agg(F.sum("times").alias("all"), F.min("first").alias("stays")).filter("all > 1")
    # Written first: the join is then one of plain scans, in which Spark can split a large group.
    stays = materialise(stays.select("group", "stays"), "stays")
    groups = materialise(groups.join(broadcast_if_small(stays, 64), "group").select("h1", "h2", "stays"), "groups")
    dropped = lines.select("id", "key", "line", "h1", "h2").join(groups, ["h1", "h2"]) \
        .filter(~F.struct("id", "key", "line").eqNullSafe(F.col("stays")))
    return materialise(dropped.groupBy("id", "key").agg(F.collect_set("line").alias("lines")), "dropped")


def drop_duplicate_lines(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                         size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without repeated lines: of each group of similar lines the first occurrence stays.

    The first occurrence is that of the smallest id (NULL before all), then
    line. Lines are compared by their words without case; two are similar if
    their SimHashes differ in at most three bits and character edits change at
    most 1 - ``least`` of the longer. Lines of fewer than 16 characters or
    without words always stay.

    All rows and columns stay; a text may become empty, a NULL text remains
    NULL. Rows that repeat id and text lose the same lines, so that each keeps
    a group's first occurrence. ``size_col``, if it is there, is set to the
    new length of a text that changed.
    """
    dropped = duplicate_lines(docs, least, id_col, text_col)
    own, lost = "_flowguard_key", "_flowguard_lines"
    columns = docs.columns
    keyed = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    rows = keyed.alias("d").join(
        dropped.alias("x"),
        F.col(f"d.{id_col}").eqNullSafe(F.col("x.id")) & (F.col(f"d.{own}") == F.col("x.key")), "left") \
        .select(*(F.col(f"d.`{c}`") for c in columns), F.col("x.lines").alias(lost))
    text_at = columns.index(text_col)
    size_at = columns.index(size_col) if size_col in columns else None

    def cut(batches):
        for whole in batches:
            for at in range(0, len(whole), PART):
                batch = whole.slice(at, PART)
                lost_lines = batch.column(len(columns))
                arrays = [batch.column(i) for i in range(len(columns))]
                if lost_lines.null_count < len(lost_lines):
                    texts = arrays[text_at].to_pylist()
                    sizes = arrays[size_at].to_pylist() if size_at is not None else None
                    for i, lines in enumerate(lost_lines.to_pylist()):
                        if lines:
                            gone = set(lines)
                            texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in gone)
                            if sizes:
                                sizes[i] = len(texts[i])
                    arrays[text_at] = pa.array(texts, arrays[text_at].type)
                    if sizes:
                        arrays[size_at] = pa.array(sizes, arrays[size_at].type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return rows.mapInArrow(cut, docs.schema)
