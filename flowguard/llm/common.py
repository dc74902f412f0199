"""Helpers shared by the corpus operators."""

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# A table is broadcast only if its counted rows times their width stay below this.
BROADCAST_BYTES = 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def broadcast_if_small(stored: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table with a broadcast hint if its counted size allows one."""
    return F.broadcast(stored) if stored.count() * row_bytes <= most else stored


def per_worker(key, make):
    """What ``make`` returns, kept for later tasks of the same Python worker.

    Functions sent by value have no module on the workers that could keep it.
    """
    kept = sys.modules.setdefault("_flowguard_worker", types.ModuleType("_flowguard_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


# Words, hashed without a Python loop

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PowerSums:
    """Hashes of any slices of a sequence, from running sums of a polynomial."""

    def __init__(self, size: int):
        self._grow(size)

    def _grow(self, n: int):
        self.power = np.cumprod(np.full(n + 1, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(n + 1, _INVERSE, np.uint64))

    def hashes(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash, never 0, of values[start[i]:end[i]] for each i."""
        n = len(values)
        if n + 1 > len(self.power):
            self._grow(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
        h = mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        return np.where(h == 0, np.uint64(1), h)


class WordHasher:
    """Finds words in UTF-8 bytes and hashes each to 64 bits.

    A word is a run of digits, letters a-z (A-Z count as a-z) and any
    non-ASCII characters. The hash of a word is a polynomial in its bytes,
    taken from running sums, so that its length costs nothing extra.
    """

    def __init__(self, block: int = 1 << 20):
        self.block = block
        byte = np.arange(256)
        self.folded = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
        f = self.folded
        self.is_word = ((f >= 48) & (f <= 57)) | ((f >= 97) & (f <= 122)) | (f >= 128)
        self.sums = PowerSums(block)

    def _piece(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the words in one piece; a text begins at each of ``firsts``."""
        word = self.is_word[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        begins[firsts] |= word[firsts]
        ends[:-1] &= ~word[1:]
        inner = firsts[firsts > 0]
        ends[inner - 1] |= word[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return self.sums.hashes(self.folded[data], start, end), start, end

    def _cuts(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cut one long text where no word is cut."""
        at, n = 0, len(data)
        while at < n:
            end = min(at + self.block, n)
            while end < n:
                apart = np.flatnonzero(~self.is_word[data[max(at, end - 4096):end]])
                if len(apart):
                    end = max(at, end - 4096) + int(apart[-1]) + 1
                    break
                end = min(end + 4096, n)
            yield at, end
            at = end

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (first row, hashes, bounds) for groups of rows of a text column.

        The words of row ``first + i`` are ``hashes[bounds[i]:bounds[i + 1]]``.
        NULL counts as empty.
        """
        for row, hashes, bounds, _ in self.sized_texts(column):
            yield row, hashes, bounds

    def sized_texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """As ``texts``, with the length of each word in bytes."""
        data, offsets = text_bytes(column)
        row, rows = 0, len(offsets) - 1
        while row < rows:
            last = int(np.searchsorted(offsets, offsets[row] + self.block, "right")) - 1
            last = min(max(last, row + 1), rows)
            own = data[offsets[row]:offsets[last]]
            if last == row + 1 and len(own) > self.block:
                parts = [self._piece(own[a:b], np.zeros(1, np.int64)) for a, b in self._cuts(own)]
                h, start, end = (np.concatenate(x) for x in zip(*parts))
                yield row, h, np.array([0, len(h)]), end - start
            else:
                at = (offsets[row:last] - offsets[row]).astype(np.int64)
                h, start, end = self._piece(own, at[at < len(own)]) if len(own) else (np.zeros(0, np.uint64), at[:0], at[:0])
                bounds = np.append(np.searchsorted(start, at), len(h))
                yield row, h, bounds, end - start
            row = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the bounds of its rows; NULL counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8), bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list column whose row i is values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


# Components of a graph

# Links that one task joins at a time, and ids of these types, whose order Arrow shares with Spark.
TASK_LINKS = 1 << 17
ARROW_ORDER = ("tinyint", "smallint", "int", "bigint", "string")


def smallest_joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of the numbers below ``n`` the smallest that links x[i] - y[i] lead to."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return root
        # Each root goes below its smallest neighbour; paths are then flat again.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _stars(roots: bool):
    """The links of a task as stars around the smallest id of each component, a block of links at a time.

    With ``roots`` the centres have a row too.
    """
    def star(block):
        ids = pa.chunked_array([x.column(i) for x in block for i in (0, 1)]).unique()
        ids = ids.take(pc.sort_indices(ids))
        x, y = (pc.index_in(pa.chunked_array([one.column(i) for one in block]), ids).to_numpy() for i in (0, 1))
        root = smallest_joined(x, y, len(ids))
        rows = np.arange(len(ids)) if roots else np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), ids.take(pa.array(root[rows]))], names=["a", "b"])

    def run(batches):
        block, size = [], 0
        for batch in batches:
            if size and size + len(batch) > TASK_LINKS:
                yield star(block)
                block, size = [], 0
            block.append(batch)
            size += len(batch)
        if size:
            yield star(block)
    return run


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The component of every end of links between different ids: (id, component).

    ``links`` has two columns a and b of one orderable type; ``component`` is
    the smallest id that a path of links reaches. Every task first makes stars
    of its own links, without a shuffle. If no more than TASK_LINKS are left,
    one task joins them. Otherwise large and small stars take turns: each id
    points its larger neighbours, then its smaller ones, to the smallest it
    knows. Both keep the components and flatten them, with at most one row per
    link and a logarithmic number of rounds. Every round is written to the
    shared folder, which cuts its lineage.
    """
    def by_end(edges):
        # Written first: both sides of the join are then plain scans, of which
        # the smaller is broadcast or a hot end is split.
        least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        return edges.join(broadcast_if_small(least, 64), "a")

    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    kind = pairs.schema["a"].dataType.simpleString()
    if kind in ARROW_ORDER:
        schema = f"a {kind}, b {kind}"
        pairs = materialise(pairs.mapInArrow(_stars(False), schema), "links")
        if pairs.count() <= TASK_LINKS:
            whole = materialise(pairs.coalesce(1).mapInArrow(_stars(True), schema), "component")
            return whole.select(F.col("a").alias("id"), F.col("b").alias("component"))
    pairs = materialise(pairs.distinct(), "links")
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = by_end(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialise(large.distinct(), "links")
        # Every row has a > b now; the smallest b of an a is its root so far.
        small = by_end(large).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                       F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        pairs = materialise(small.select("col.*").filter("a <> b").distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("b").alias("id")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")) \
        .union(roots.select("id", F.col("id").alias("component")))
