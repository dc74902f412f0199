"""Binary records against the tokenizers library, known checksums and planted damage."""

import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge import documents, empty, odd, odd_rows, rows, with_clashes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowguard.llm import records
from flowguard.session import scratch_path

WORD = public_tokenizers.path("word_bpe_49k.json")


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums(monkeypatch):
    assert slow_crc32c(b"123456789") == 0xE3069283
    rnd = random.Random(1)
    data = [rnd.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 9, 63, 64, 65, 127, 128, 1000, 4096, 5000, 2048)] + [b"123456789"]
    sizes = np.array([len(d) for d in data])
    for piece in (1 << 22, 1 << 10):
        monkeypatch.setattr(records, "PIECE", piece)
        got = records.Checksums().of(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes)
        assert got.tolist() == [slow_crc32c(d) for d in data]


def expected(source):
    library = Tokenizer.from_file(WORD)
    for doc_id, text in source:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        yield doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def check(got, source):
    assert sorted(((r[0], *r[2:]) for r in got), key=repr) == sorted(expected(source), key=repr)
    got = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in got] == (np.cumsum([r[2] for r in got]) - [r[2] for r in got]).tolist()
    ids = [-1 if r[0] is None else r[0] for r in got]
    assert ids == sorted(ids)


def test_described(spark):
    check(rows(records.described(with_clashes(odd(spark)), WORD)), [r[:2] for r in odd_rows()])
    source = [r[:2] for r in documents()] + [(7, "one id on many rows")] * 500
    df = spark.createDataFrame(random.Random(2).sample(source, len(source)), "doc_id long, text string").repartition(5)
    check(rows(records.described(df, WORD)), source)
    assert rows(records.described(empty(spark), WORD)) == []


@pytest.fixture
def written(spark):
    folder = scratch_path(spark, "test-records")
    df = spark.createDataFrame([r[:2] for r in documents()], "doc_id long, text string")
    records.write_records(df, WORD, folder, file_bytes=20_000)
    return folder


def test_the_files_are_length_delimited(spark, written):
    files = records.manifest(spark, written).orderBy("place", "number").collect()
    assert len(files) > 10
    masked = lambda data: (((c := slow_crc32c(data)) >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    n = 0
    for file in files[:3]:
        raw, at, tokens = open(f"{written}/{file.file}.records", "rb").read(), 0, 0
        index = open(f"{written}/{file.file}.index", "rb").read()
        for i in range(file.records):
            assert struct.unpack_from("<QQ", index, 16 * i) == (at, tokens)
            size, check_ = struct.unpack_from("<QI", raw, at)
            data = raw[at + 12:at + 12 + size]
            assert check_ == masked(raw[at:at + 8]) and struct.unpack_from("<I", raw, at + 12 + size)[0] == masked(data)
            tokens, at, n = tokens + (size - 10) // 2, at + 16 + size, n + 1
        assert at == len(raw) == file.bytes and tokens == file.tokens and len(index) == 16 * file.records
    assert n


def test_shuffled_reads(spark, written):
    plain = [tuple(r) for r in records.fetch(records.locations(spark, written), written).collect()]
    first, second, again = ([tuple(r) for r in records.read_shuffled(spark, written, seed).collect()] for seed in (1, 2, 1))
    assert first == again and first != second and first != plain
    assert sorted(first, key=lambda r: r[1]) == sorted(second, key=lambda r: r[1]) == sorted(plain, key=lambda r: r[1])
    assert len(plain) == len(documents())
    # A single record is reached by its place in the index.
    place = records.locations(spark, written).filter(F.col("start") == plain[17][1])
    assert [tuple(r) for r in records.fetch(place, written).collect()] == [plain[17]]


@pytest.mark.parametrize("at", [0, 9, 30, -1])
def test_damage_is_found(spark, written, at):
    file = records.manifest(spark, written).first().file
    path = f"{written}/{file}.records"
    raw = bytearray(open(path, "rb").read())
    raw[at] ^= 4
    os.remove(path)
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="Corrupt"):
        records.fetch(records.locations(spark, written), written).collect()


def test_files_of_lost_tasks_do_not_count(spark, written):
    want = records.fetch(records.locations(spark, written), written).count()
    lost = records._File(written, 0)
    lost.add([1], [np.array([5], np.int32)], 2)
    lost.close()
    assert records.fetch(records.locations(spark, written), written).count() == want
