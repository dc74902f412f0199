"""Packs token sequences into fixed-length training sequences.

Bounded-space online best-fit: a fixed number of bins is open at a time. The
free spaces that some open bin has are the set bits of one integer, so that
the tightest bin for a piece is the lowest set bit at or above its length. If
none fits and the bins are used up, the fullest is closed first.
"""

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .bpe import Encoder, texts_of
from .common import per_worker

CAPACITY = 4096
OPEN_BINS = 64
END_ID = 1
# Bins left open by so many tasks are packed again together.
TASKS_JOINED = 16

COLUMNS = ("piece", "start", "length", "ids_crc32")


class Bins:
    """Open bins of one task; ``place`` returns the rows of bins that it closes."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f is set if an open bin has f tokens left
        self.by_free: dict[int, list[int]] = {}
        self.rows: dict[int, list[tuple]] = {}
        self.made = 0

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        number = own.pop()
        if not own:
            self.free &= ~(1 << free)
        return number

    def _close(self, number: int) -> list[tuple]:
        return [(*row, number, offset) for offset, row in self.rows.pop(number)]

    def place(self, length: int, row: tuple) -> list[tuple]:
        closed = []
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if len(self.rows) >= self.most:
                closed += self._close(self._take((self.free & -self.free).bit_length() - 1))
            free, number, self.made = self.capacity, self.made, self.made + 1
            self.rows[number] = []
        self.rows[number].append((self.capacity - free, row))
        if free > length:
            self.by_free.setdefault(free - length, []).append(number)
            self.free |= 1 << (free - length)
        else:
            closed += self._close(number)
        return closed

    def left_open(self) -> list[tuple]:
        return [row for number in list(self.rows) for row in self._close(number)]


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of one document; only what exceeds the capacity is cut."""
    for piece, start in enumerate(range(0, len(ids), capacity)):
        own = ids[start:start + capacity]
        yield piece, start, len(own), zlib.crc32(own.astype("<u4").data)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of every text, each followed by ``end_id``, into few sequences.

    Returns a row per piece: ``id_col``, piece, start, length, ids_crc32,
    sequence_id and offset. NULL and empty texts are the end id alone; repeated
    rows are packed each; rows of a NULL id are packed like others. An empty
    table gives no rows.

    Every task packs what it encodes, without a shuffle. Bins that tasks leave
    open are packed again by ever fewer tasks, largest pieces first, until one
    task is left, which has at most ``open_bins`` * TASKS_JOINED of them.
    Each round is written, so that no text is encoded twice.
    """
    plain = docs.select(F.col(id_col), F.col(text_col))
    kind = plain.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, "
              "offset long, open boolean")
    id_type = {"names": [id_col, *COLUMNS, "sequence_id", "offset", "open"]}

    def batch_of(rows, like, round_, is_open):
        base = (round_ << 56) | (TaskContext.get().partitionId() << 32)
        columns = list(zip(*rows))
        arrays = [pa.array(columns[0], like), pa.array(columns[1], pa.int32())]
        arrays += [pa.array(c, pa.int64()) for c in columns[2:5]]
        arrays += [pa.array([base | n for n in columns[5]], pa.int64()), pa.array(columns[6], pa.int64()),
                   pa.array([is_open] * len(rows))]
        return pa.RecordBatch.from_arrays(arrays, **id_type)

    def packed(placed: Iterator[tuple[int, tuple]], bins: Bins, like, round_):
        rows = []
        for length, row in placed:
            rows += bins.place(length, row)
            if len(rows) >= 10_000:
                yield batch_of(rows, like(), round_, False)
                rows = []
        if rows:
            yield batch_of(rows, like(), round_, False)
        rows = bins.left_open()
        if rows:
            yield batch_of(rows, like(), round_, True)

    def encode(batches):
        encoder = per_worker(("bpe", path), lambda: Encoder(path))
        seen, names = [], deque()

        def texts():
            for batch in batches:
                seen[:] = [batch.column(0).type]
                names.extend(batch.column(0).to_pylist())
                yield from texts_of(batch.column(1))

        def placed():
            # The encoder reads ahead, across batches, what it merges at once.
            for ids in encoder.encode(texts()):
                name = names.popleft()
                for piece in pieces_of(np.append(ids, np.int32(end_id)), capacity):
                    yield piece[2], (name, *piece)

        yield from packed(placed(), Bins(capacity, open_bins), lambda: seen[0], 0)

    def again(round_):
        def run(batches):
            seen = []

            def placed():
                for batch in batches:
                    seen[:] = [batch.column(0).type]
                    for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                        yield row[3], row

            yield from packed(placed(), Bins(capacity, open_bins), lambda: seen[0], round_)
        return run

    result = materialise(plain.mapInArrow(encode, schema), "packed")
    done = result.filter(~F.col("open"))
    open_ = result.filter("open")
    before = None
    for round_ in range(1, 100):
        left = open_.agg(F.count_distinct("sequence_id")).first()[0]
        if not left or before == 1:
            break
        tasks = max(1, -(-left // (open_bins * TASKS_JOINED)))
        # Written pieces lie as the tasks left them; joining neighbours needs no shuffle.
        again_ = open_.select(id_col, *COLUMNS).coalesce(tasks) \
            .sortWithinPartitions(F.desc("length"), id_col, "piece")
        result = materialise(again_.mapInArrow(again(round_), schema), "packed")
        done = done.unionByName(result.filter(~F.col("open")))
        open_, before = result.filter("open"), tasks
    return done.unionByName(open_).drop("open")
