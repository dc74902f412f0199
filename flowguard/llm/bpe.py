"""Byte-pair encoding and decoding with a pair occurrence index.

Texts are cut into pieces, and many distinct pieces of a block of rows are
merged at once: an index maps each mergeable pair to all its positions in
them, the active ranks are applied in ascending order, and each merge
updates the lists of the pairs that it creates.
"""

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PowerSums, per_worker, ragged

# Characters cut into pieces at once, characters of a block, characters of its
# new pieces merged at once, and distinct pieces kept for later blocks.
CUT_CHARS = 1 << 18
MERGE_CHARS = 16 << 20
NEW_CHARS = 1 << 20
KEPT_PIECES = 500_000
# Pairs ranked at once.
PAIRS = 1 << 16
# Texts that are held as Python values at a time.
PART = 256

# The white space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, SPACE, OTHER, SPECIAL = range(5)


def char_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                        np.uint8, sys.maxunicode + 1)
    table[WHITE] = SPACE
    return table


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols, extra = {}, 0
    for byte in range(256):
        if byte in plain:
            symbols[byte] = chr(byte)
        else:
            symbols[byte] = chr(256 + extra)
            extra += 1
    return [symbols[byte] for byte in range(256)]


class Vocabulary:
    """Symbols, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.kind = "word" if self.suffix else "byte"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int32)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        # A merge whose product takes part in an earlier one may make that one active again.
        earliest = np.full(self.size, len(merges), np.int64)
        for side in (left, right):
            np.minimum.at(earliest, side, np.arange(len(merges)))
        self.returns = earliest[self.merged] < np.arange(len(merges))
        # What each id stands for, as bytes.
        byte_of = {s: bytes([b]) for b, s in enumerate(symbols)}
        self.bytes = np.full(self.size, b"", object)
        for token, i in vocab.items():
            bare = token[:-len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            end = b" " if bare != token else b""
            self.bytes[i] = b"".join(byte_of[c] for c in bare) + end
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        ranks = np.empty(len(a), np.int32)
        for i in range(0, len(a), PAIRS):
            key = a[i:i + PAIRS].astype(np.int64) * self.size + b[i:i + PAIRS]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ranks[i:i + PAIRS] = np.where(self.keys[at] == key, self.order[at], -1)
        return ranks


def merge(vocabulary: Vocabulary, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one after the other, and the bounds of each piece."""
    raw = [p.encode() for p in pieces]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), bounds
    symbol = vocabulary.first[data]
    last = bounds[1:][sizes > 0] - 1
    symbol[last] = vocabulary.final[data[last]]
    # Neighbours inside a piece; n stands for none, so that writes there do no harm.
    after = np.arange(1, n + 1, dtype=np.int32)
    after[last] = n
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[bounds[:-1][sizes > 0]] = n
    symbol = np.append(symbol, np.int32(-1))
    after, before = np.append(after, np.int32(n)), np.append(before, np.int32(n))

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(rank: np.ndarray, position: np.ndarray):
        """Add positions to the lists of their pairs."""
        known = rank >= 0
        rank, position = rank[known], position[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, position = rank[order], position[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, own in zip(rank[np.append(0, cuts)].tolist(), np.split(position, cuts)):
            if r in index:
                index[r].append(own)
            else:
                index[r] = [own]
                heapq.heappush(active, r)

    first = np.flatnonzero(after[:n] < n).astype(np.int32)
    enter(vocabulary.ranks(symbol[first], symbol[first + 1]), first)
    while active:
        rank = heapq.heappop(active)
        found = index.pop(rank)
        a, b = vocabulary.left[rank], vocabulary.right[rank]
        at = found[0] if len(found) == 1 else _distinct(np.concatenate(found))
        # Positions whose pair an earlier merge has changed are stale.
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
        if not len(at):
            continue
        if a == b and len(at) > 1:
            at = _alternate(at, after)
        if vocabulary.returns[rank] and len(at) > 1:
            # The merge may revive an earlier rank: one place per piece at a time.
            piece = np.searchsorted(bounds, at, "right")
            own = np.append(True, piece[1:] != piece[:-1])
            if not own.all():
                index[rank] = [at[~own]]
                heapq.heappush(active, rank)
                at = at[own]
        gone = after[at]
        following = after[gone]
        symbol[at] = vocabulary.merged[rank]
        symbol[gone] = -1
        after[at] = following
        before[following] = at
        leading = before[at]
        # New pairs: with what follows, and with what leads unless that was merged too and is entered above.
        left, right = leading[leading < n], at[following < n]
        position = _distinct(np.concatenate([left, right]))
        enter(vocabulary.ranks(symbol[position], symbol[after[position]]), position)
    alive = np.flatnonzero(symbol[:n] >= 0)
    return symbol[alive], np.searchsorted(alive, bounds)


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping places of a pair of equal symbols, every other one from the left."""
    at = np.sort(at)
    run = np.cumsum(np.append(True, after[at[:-1]] != at[1:]))
    start = np.searchsorted(run, run, "left")
    return at[(np.arange(len(at)) - start) % 2 == 0]


class PieceNumbers:
    """Numbers pieces by their 64-bit hash, in an open-addressing table.

    A hash only finds a piece; whether it is the same is asked of the pieces themselves.
    """

    def __init__(self, slots: int = 1 << 20):
        self.hash = np.zeros(slots, np.uint64)
        self.number = np.zeros(slots, np.int32)
        self.count = 0

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        found = np.full(len(h), -1, np.int32)
        open_, mask = np.arange(len(h)), np.uint64(len(self.hash) - 1)
        slot = (h & mask).astype(np.int64)
        while len(open_):
            there = self.hash[slot]
            hit = there == h[open_]
            found[open_[hit]] = self.number[slot[hit]]
            on = ~hit & (there != 0)
            open_, slot = open_[on], (slot[on] + 1) & int(mask)
        return found

    def add(self, h: np.ndarray):
        """Number distinct hashes that are not there yet, in their order."""
        if 4 * (self.count + len(h)) > 3 * len(self.hash):
            old, numbers = self.hash, self.number
            size = len(old)
            while 4 * (self.count + len(h)) > 3 * size:
                size *= 2
            self.hash, self.number = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            kept = old != 0
            self._place(old[kept], numbers[kept])
        self._place(h, np.arange(self.count, self.count + len(h), dtype=np.int32))
        self.count += len(h)

    def _place(self, h, numbers):
        mask = len(self.hash) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.hash[slot] == 0
            self.hash[slot[free]] = h[free]
            own = self.hash[slot] == h
            self.number[slot[own]] = numbers[own]
            h, numbers, slot = h[~own], numbers[~own], (slot[~own] + 1) & mask


class Grown:
    """An array that rows are added to; at most a quarter of it is spare."""

    def __init__(self, dtype):
        self.rows, self.count = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray):
        count = self.count + len(values)
        if count > len(self.rows):
            rows = np.zeros(count + count // 4, self.rows.dtype)
            rows[:self.count] = self.rows[:self.count]
            self.rows = rows
        self.rows[self.count:count] = values
        self.count = count

    def __getitem__(self, at) -> np.ndarray:
        return self.rows[at]


class Encoder:
    """Encodes texts block by block; knows the pieces it has met before."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.vocabulary = Vocabulary(path)
        self.classes = char_classes()
        self.sums = PowerSums(CUT_CHARS)
        self.kept = kept
        special = self.vocabulary.special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.lead = tuple(s[:2] for s in special)
        self.roomy = re.compile(r"(?<=\S) (?=\S)")
        self._forget()

    def _forget(self):
        self.numbers = PieceNumbers()
        # The characters of all numbered pieces, and pieces whose hash another one has.
        self.codes, self.begins, self.lengths = Grown(np.uint32), Grown(np.int64), Grown(np.int32)
        self.others: dict[str, int] = {}
        self.ids, self.starts, self.sizes = Grown(np.int32), Grown(np.int64), Grown(np.int32)
        self.waiting: list[str] = []
        for token, i in self.vocabulary.special.items():
            # Special tokens are pieces that are known from the start.
            codes = np.frombuffer(token.encode("utf-32-le"), np.uint32)
            self.numbers.add(self.sums.hashes(codes, np.array([0]), np.array([len(codes)])))
            self._keep(codes, np.array([0]), np.array([len(codes)]))
            self._learn(np.array([i], np.int32), np.array([0, 1]))

    def _learn(self, ids, bounds):
        self.starts.add(bounds[:-1] + self.ids.count)
        self.sizes.add(np.diff(bounds))
        self.ids.add(ids)

    def _merge_waiting(self):
        """Merge the pieces that wait, some of them at once: what that needs is a multiple of their size."""
        waiting, self.waiting = self.waiting, []
        at = 0
        while at < len(waiting):
            end, chars = at, 0
            while end < len(waiting) and (end == at or chars + len(waiting[end]) <= NEW_CHARS):
                chars += len(waiting[end])
                end += 1
            self._learn(*merge(self.vocabulary, waiting[at:end]))
            at = end

    def _keep(self, codes, start, end):
        """Store the characters of newly numbered pieces."""
        sizes = end - start
        self.begins.add(self.codes.count + np.cumsum(sizes) - sizes)
        self.lengths.add(sizes)
        self.codes.add(codes[ragged(start, sizes)])

    def _unlike(self, numbers, codes, start, end) -> np.ndarray:
        """Which pieces codes[start:end] are not those that their numbers stand for."""
        sizes = end - start
        unlike = self.lengths[numbers] != sizes
        rows = np.flatnonzero(~unlike)
        differ = codes[ragged(start[rows], sizes[rows])] != self.codes[ragged(self.begins[numbers[rows]], sizes[rows])]
        if differ.any():
            unlike[np.repeat(rows, sizes[rows])[differ]] = True
        return np.flatnonzero(unlike)

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text as segments that no piece crosses, and whether each is a special token."""
        parts = [text]
        if self.split and any(s in text for s in self.lead):
            parts = self.split(text)
        for part in parts:
            special = part in self.vocabulary.special
            if not special and self.vocabulary.kind == "word":
                part = lower(unicodedata.normalize("NFC", part))
            at = 0
            while len(part) - at > CUT_CHARS:
                # Before a single space between other characters, where pieces never join.
                place = self.roomy.search(part, at + CUT_CHARS - (CUT_CHARS >> 3))
                if not place:
                    break
                yield part[at:place.start()], special
                at = place.start()
            if at < len(part):
                yield part[at:], special

    def _number(self, segments: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of some segments and the bounds of each segment."""
        text = "".join(s for s, _ in segments)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.cumsum([0, *(len(s) for s, _ in segments)])
        kind = self.classes[codes]
        for i, (_, special) in enumerate(segments):
            if special:
                kind[first[i]:first[i + 1]] = SPECIAL
        start, end = cut(codes, kind, first[:-1], self.vocabulary.kind == "byte")
        h = self.sums.hashes(codes, start, end)
        found = self.numbers.look_up(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            values, at, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            found[new] = self.numbers.count + inverse
            at = new[at]
            self.waiting += [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            self.numbers.add(values)
            self._keep(codes, start[at], end[at])
        for i in self._unlike(found, codes, start, end):
            piece = text[start[i]:end[i]]
            if piece not in self.others:
                self.others[piece] = self.numbers.count
                self.numbers.count += 1
                self.waiting.append(piece)
                self._keep(codes, start[i:i + 1], end[i:i + 1])
            found[i] = self.others[piece]
        return found, np.searchsorted(start, first)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts are taken one by one as they are numbered, and not kept."""
        texts = iter(texts)
        text = next(texts, None)
        while text is not None:
            if self.numbers.count > self.kept:
                self._forget()
            # Number the pieces of some texts, then merge all that are new at once.
            numbered, bounds, begun, chars = [], [np.zeros(1, np.int64)], [0], 0
            segments, size, total = [], 0, 0

            def flush():
                nonlocal segments, size, total
                if segments:
                    found, own = self._number(segments)
                    numbered.append(found)
                    bounds.append(own[1:] + total)
                    total += len(found)
                    segments, size = [], 0

            count = 0
            while text is not None and (not count or chars + len(text) <= MERGE_CHARS):
                for segment in self._segments(text):
                    if size + len(segment[0]) > CUT_CHARS:
                        flush()
                    segments.append(segment)
                    size += len(segment[0])
                    count += 1
                begun.append(count)
                chars += len(text)
                text = next(texts, None)
            flush()
            self._merge_waiting()
            of_text = np.concatenate(bounds)[np.array(begun)]
            # What was cut at once goes as soon as its texts are done.
            numbered.reverse()
            pieces, at = np.zeros(0, np.int32), 0
            for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist()):
                while at + len(pieces) < b:
                    pieces, at = np.concatenate([pieces[a - at:], numbered.pop()]), a
                own = pieces[a - at:b - at]
                yield self.ids[ragged(self.starts[own], self.sizes[own])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, special tokens included."""
        return b"".join(self.vocabulary.bytes[ids].tolist()).decode("utf-8", "replace")


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of a column, few at a time as Python values; NULL counts as empty."""
    for at in range(0, len(column), PART):
        for text in column.slice(at, PART).to_pylist():
            yield "" if text is None else text


def cut(codes: np.ndarray, kind: np.ndarray, first: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of some segments; one begins at each of ``first``.

    Pieces are contractions ('s 't 'm 'd 're 've 'll), runs of letters, of
    numbers (single ones without ``spaces``) and of other visible characters.
    With ``spaces`` each takes one blank before it, and what is left of white
    space are pieces too; without, white space is dropped.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    begins = head.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    if spaces:
        # The last white space of a run that something follows stands apart ...
        last = np.flatnonzero(space & begins[1:] & ~head[1:])
        begins[last] = True
        # ... and, if it is a blank, belongs to what follows.
        blank = last[codes[last] == 32]
        begins[blank + 1] = False
    else:
        begins[:n] |= kind == NUMBER
    quote = np.flatnonzero((codes == 39) & begins[:n] & begins[1:])
    quote = quote[~head[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        # Up to two letters after the quote, none beyond its segment.
        padded = np.append(codes, [0, 0])
        one, two = padded[quote + 1], np.where(head[np.minimum(quote + 2, n)], 0, padded[quote + 2])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        quote, length = quote[single | double], np.where(single, 2, 3)[single | double]
        begins[quote + 1] = False
        begins[np.minimum(quote + length, n)] = True
    start = np.flatnonzero(begins[:n])
    end = np.append(start[1:], n)
    if not spaces:
        visible = ~space[start]
        start, end = start[visible], end[visible]
    return start, end


def lower(text: str) -> str:
    """Lower case, each character by itself (a final sigma gets no form of its own)."""
    return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids again and describe both.

    Returns ``id_col``, n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the decoded text in
    UTF-8). NULL counts as empty: no tokens. Repeated rows are encoded each;
    other columns are not read.
    """
    def run(batches):
        encoder = per_worker(("bpe", path), lambda: Encoder(path))
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for ids in encoder.encode(texts_of(batch.column(1))):
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").data).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col(id_col), F.col(text_col))
    kind = plain.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows of ``docs`` with the ids of their text as an array of integers.

    A column of that name in ``docs`` is refused with a ValueError.
    """
    if ids_col in docs.columns:
        raise ValueError(f"the table has a column {ids_col!r} already")
    at = docs.columns.index(text_col)

    def run(batches):
        encoder = per_worker(("bpe", path), lambda: Encoder(path))
        for batch in batches:
            ids = [pa.array(x, pa.int32()) for x in encoder.encode(texts_of(batch.column(at)))]
            bounds = np.cumsum([0, *map(len, ids)])
            flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
            column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids_col])

    schema = docs.select("*", F.lit(None).cast("array<int>").alias(ids_col)).schema
    return docs.mapInArrow(run, schema)


def decode_column(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All rows of ``docs`` with the text that their ids stand for; NULL ids give NULL."""
    if text_col in docs.columns:
        raise ValueError(f"the table has a column {text_col!r} already")
    at = docs.columns.index(ids_col)

    def run(batches):
        encoder = per_worker(("bpe", path), lambda: Encoder(path))
        for batch in batches:
            texts = [None if ids is None else encoder.decode(np.array(ids, np.int64))
                     for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, text_col])

    schema = docs.select("*", F.lit(None).cast("string").alias(text_col)).schema
    return docs.mapInArrow(run, schema)
