"""Encoding against the tokenizers library, exact round trips, and packing by its rules."""

import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from edge import documents, empty, odd, odd_rows, rows, with_clashes
from tokenizers import Tokenizer

from flowguard.llm import bpe, packing

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def odd_texts():
    rnd = random.Random(3)
    parts = ["abc", "ABC", "'s", "'re", "I'll", "''d", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "Σς", "İ", "中文", "٣", "½",
             "_", "-", "<|endoftext|>", "<|startoftext|>", "12345", "\x1c", "\x85", " ", "🙂", "J̌", "aaaaaaa"]
    yield from ("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500))
    yield from ("".join(chr(rnd.randint(1, 0x2FF)) for _ in range(30)) for _ in range(500))
    yield "word " * 300_000
    yield "\n" * 5000 + "x"


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(path):
    library = Tokenizer.from_file(path)
    texts = [*odd_texts(), *(r[1] for r in documents())]
    for text, ids in zip(texts, bpe.Encoder(path).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:200]


def thue_morse(n):
    """Two words whose polynomial hashes are equal modulo 2**64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_one_hash_keep_their_own_ids(path):
    library = Tokenizer.from_file(path)
    x, y = thue_morse(2048)
    for texts in ([x, y], [y, x], [f"{x} {y} {x}", y], [y], [x + " " + y[:-1] + "c", y]):
        got = [ids.tolist() for ids in bpe.Encoder(path).encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = bpe.Encoder(path)
    for text in (x, y, x, y):
        assert next(encoder.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_are_taken_as_they_are_numbered(monkeypatch):
    monkeypatch.setattr(bpe, "MERGE_CHARS", 1000)
    taken = []
    texts = (taken.append(i) or f"some words and the number {i}" for i in range(100_000))
    ids = bpe.Encoder(WORD).encode(texts)
    first = next(ids)
    assert len(taken) < 60
    assert first.tolist() == Tokenizer.from_file(WORD).encode("some words and the number 0", add_special_tokens=False).ids


def test_pieces_forgotten_between_blocks_change_nothing(monkeypatch):
    texts = [r[1] for r in documents()]
    want = [ids.tolist() for ids in bpe.Encoder(BYTE).encode(texts)]
    monkeypatch.setattr(bpe, "MERGE_CHARS", 20_000)
    monkeypatch.setattr(bpe, "CUT_CHARS", 3_000)
    assert [ids.tolist() for ids in bpe.Encoder(BYTE, kept=50).encode(texts)] == want


def test_new_words_are_merged_in_bounded_memory():
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=8)) for _ in range(1000)) for _ in range(250)]
    encoder = bpe.Encoder(WORD)
    tracemalloc.start()
    got = sum(len(ids) for ids in encoder.encode(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    library = Tokenizer.from_file(WORD)
    assert got == sum(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert peak < 100e6, peak


def test_round_trip(spark):
    got = rows(bpe.round_trip(with_clashes(odd(spark)), BYTE))
    library = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert rows(bpe.round_trip(empty(spark), BYTE)) == []


def test_columns_of_ids_decode_to_the_texts(spark):
    df = bpe.decode_column(bpe.encode_column(with_clashes(odd(spark)), BYTE), BYTE)
    for row in df.select("text", "decoded").collect():
        assert row.decoded == (row.text or "")
    with pytest.raises(ValueError):
        bpe.encode_column(df, BYTE)


def check_packing(result, source, capacity, bins):
    library = Tokenizer.from_file(WORD)
    want = []
    for doc_id, text in source:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start:start + capacity]
            want.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    assert sorted((r[:5] for r in result), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for *_, length, _, sequence, offset in result:
        sequences[sequence].append((offset, length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r[3] for r in result) // capacity)


def test_packing_of_odd_rows(spark):
    result = rows(packing.pack(with_clashes(odd(spark)), WORD, capacity=128, open_bins=4))
    check_packing(result, [r[:2] for r in odd_rows()], 128, 4)
    assert rows(packing.pack(empty(spark), WORD)) == []


def test_packing_is_tight(spark):
    source = documents("/root/testdata/sf0.01")
    df = spark.createDataFrame([r[:2] for r in source], "doc_id long, text string").repartition(6)
    used, least = check_packing(rows(packing.pack(df, WORD)), [r[:2] for r in source], 4096, 64)
    assert used <= 1.02 * least + 1


def test_the_fullest_bin_closes_first():
    bins = packing.Bins(10, 2)
    assert bins.place(6, ("a",)) == [] and bins.place(7, ("b",)) == []
    # Nothing fits and both bins are used: b, which is fuller, goes.
    assert bins.place(8, ("c",)) == [("b", 1, 0)]
    # The tightest bin that fits takes the piece, and closes when it is full.
    assert bins.place(2, ("d",)) == [("c", 2, 0), ("d", 2, 8)]
    assert bins.left_open() == [("a", 0, 0)]
