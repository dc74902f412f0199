"""Token ids as length-delimited binary records, with a separate index of offsets.

A record is a 64-bit length, the masked CRC-32C of these eight bytes, the data,
and the masked CRC-32C of the data, all little-endian: the framing of TFRecord
files. The data are a mark (1 if the document has an id), the id of the
document in 64 bits, the width of a token in bytes, and the tokens.

Beside every file of records lies an index, one 16-byte entry per record: the
offset in the file and the number of tokens before it in the file. So readers
can begin anywhere, take records in any order, or share one file among tasks.
A manifest, one row per file, says which files count: a task that was lost
leaves files that no manifest names.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .bpe import Encoder
from .common import per_worker, ragged

END_ID = 2
# A task begins a new file beyond so many bytes, a reader takes about so many at once, and a writer so many characters.
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
BLOCK_CHARS = 4 << 20

FRAME = 16
HEAD = "<?qB"
# The reversed polynomial of CRC-32C, and what masks a checksum.
CASTAGNOLI, MASK = 0x82F63B78, 0xA282EAD8
BLOCK, PIECE = 64, 1 << 20


class Checksums:
    """CRC-32C of many byte strings at once.

    The register after two neighbouring runs of bytes is that after the first,
    moved on by the length of the second, xor that of the second alone. So all
    pairs of bytes are looked up at once, and runs of equal length are joined in pairs.
    """

    def __init__(self):
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), table >> np.uint32(1))
        # The register after any two bytes, the first of which is the lower half of the index.
        pair = np.arange(1 << 16, dtype=np.uint32)
        one = table[pair & np.uint32(0xFF)]
        self.table = table[(one ^ (pair >> np.uint32(8))) & np.uint32(0xFF)] ^ (one >> np.uint32(8))
        # moves[k] moves a register on by 2**k bytes, a table per byte of the register.
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = table[bits & np.uint32(0xFF)] ^ (bits >> np.uint32(8))
        self.moves = []
        for _ in range(40):
            self.moves.append(self._tables(one))
            one = self._move(one, len(self.moves) - 1)

    @staticmethod
    def _tables(image: np.ndarray) -> np.ndarray:
        """Tables of a linear map, from the images of the 32 bits."""
        out = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            own = (np.arange(256) >> (bit & 7)) & 1 == 1
            out[bit >> 3, own] ^= image[bit]
        return out

    def _move(self, register: np.ndarray, k: int) -> np.ndarray:
        t = self.moves[k]
        return (t[0][register & np.uint32(255)] ^ t[1][(register >> np.uint32(8)) & np.uint32(255)]
                ^ t[2][(register >> np.uint32(16)) & np.uint32(255)] ^ t[3][register >> np.uint32(24)])

    def _registers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ones: bool) -> np.ndarray:
        """The registers after some strings of up to PIECE bytes, which begin with ones or empty."""
        out = np.zeros(len(starts), np.uint32)
        # Leading zeros do not change an empty register, so that strings are padded to a power of two of blocks.
        classes = np.ceil(np.log2(np.maximum(-(-sizes // BLOCK), 1))).astype(np.int64)
        for k in np.unique(classes):
            rows, width = np.flatnonzero(classes == k), BLOCK << int(k)
            step = max(1, PIECE // width)
            for at in range(0, len(rows), step):
                own = rows[at:at + step]
                size = sizes[own]
                padded = np.zeros(len(own) * width, np.uint8)
                begin = np.arange(len(own)) * width + width - size
                padded[ragged(begin, size)] = data[ragged(starts[own], size)]
                if ones:
                    # The same as ones added to the first four bytes.
                    padded[ragged(begin, np.minimum(size, 4))] ^= 0xFF
                register, level = self.table[padded.view("<u2")].reshape(len(own), width // 2), 1
                while register.shape[1] > 1:
                    register = self._move(register[:, 0::2], level) ^ register[:, 1::2]
                    level += 1
                register = register[:, 0]
                if ones:
                    # Ones that met no byte are still at the low end of the register.
                    for short in np.flatnonzero(size < 4):
                        register[short] ^= np.uint32(0xFFFFFFFF >> (8 * int(size[short])))
                out[own] = register
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The CRC-32C of data[starts[i]:starts[i] + sizes[i]] for each i."""
        # Long strings go on piece by piece after a first one that holds the rest.
        first = np.where(sizes > PIECE, (sizes - 1) % PIECE + 1, sizes)
        register = self._registers(data, starts, first, True)
        for i in np.flatnonzero(sizes > PIECE):
            at, end, one = int(starts[i] + first[i]), int(starts[i] + sizes[i]), register[i:i + 1]
            while at < end:
                one = self._move(one, PIECE.bit_length() - 1) ^ self._registers(data, np.array([at]), np.array([PIECE]), False)
                at += PIECE
            register[i] = one[0]
        return ~register

    def masked(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        crc = self.of(data, starts, sizes)
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def _checksums() -> Checksums:
    return per_worker("crc32c", Checksums)


class Corrupt(ValueError):
    """A record whose frame or checksums do not agree."""


def frame(ids: list, tokens: list[np.ndarray], width: int) -> tuple[bytes, np.ndarray]:
    """The records of some documents, and where each begins."""
    kind = {2: "<u2", 4: "<u4"}[width]
    data = [struct.pack(HEAD, i is not None, i or 0, width) + t.astype(kind).tobytes() for i, t in zip(ids, tokens)]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    lengths = sizes.astype("<u8").view(np.uint8)
    body = np.frombuffer(b"".join(data), np.uint8)
    first = np.cumsum(sizes) - sizes
    eight = np.full(len(data), 8)
    checks = _checksums()
    of_length = checks.masked(lengths, np.arange(len(data)) * 8, eight).astype("<u4")
    of_data = checks.masked(body, first, sizes).astype("<u4")
    out = np.zeros(len(body) + FRAME * len(data), np.uint8)
    begin = first + FRAME * np.arange(len(data))
    out[ragged(begin, eight)] = lengths
    out[ragged(begin + 8, eight // 2)] = of_length.view(np.uint8)
    out[ragged(begin + 12, sizes)] = body
    out[ragged(begin + 12 + sizes, eight // 2)] = of_data.view(np.uint8)
    return out.tobytes(), begin


def unframe(block: bytes, offsets: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, tokens) of the records that begin at some places of a block; Corrupt if anything is amiss."""
    data = np.frombuffer(block, np.uint8)
    if len(offsets) and (offsets[-1] + FRAME > len(data) or offsets[0] < 0):
        raise Corrupt("a record ends too early")
    eight = np.full(len(offsets), 8)
    sizes = data[ragged(offsets, eight)].view("<u8").astype(np.int64)
    checks = _checksums()
    given = data[ragged(offsets + 8, eight // 2)].view("<u4")
    if (checks.masked(data, offsets, eight) != given).any():
        raise Corrupt("a length does not agree with its checksum")
    if (offsets + FRAME + sizes > len(data)).any():
        raise Corrupt("a record ends too early")
    given = data[ragged(offsets + 12 + sizes, eight // 2)].view("<u4")
    if (checks.masked(data, offsets + 12, sizes) != given).any():
        raise Corrupt("data do not agree with their checksum")
    for at, size in zip((offsets + 12).tolist(), sizes.tolist()):
        known, name, width = struct.unpack_from(HEAD, block, at)
        yield (name if known else None), np.frombuffer(block, {2: "<u2", 4: "<u4"}[width], (size - struct.calcsize(HEAD)) // width, at + struct.calcsize(HEAD))


def _open(uri: str):
    """A file system and a path on it; any that Arrow reaches will do (local, HDFS, object stores)."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _File:
    """A file of records and its index while they are written."""

    def __init__(self, folder: str, place: int):
        self.name = f"part-{place:010d}-{uuid.uuid4().hex}"
        self.store, base = _open(folder)
        self.data = self.store.open_output_stream(f"{base}/{self.name}.records")
        self.index = self.store.open_output_stream(f"{base}/{self.name}.index")
        self.bytes = self.records = self.tokens = 0

    def add(self, ids, tokens, width):
        block, begin = frame(ids, tokens, width)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        before = self.tokens + np.cumsum(sizes) - sizes
        self.data.write(block)
        self.index.write(np.stack([begin + self.bytes, before], axis=1).astype("<u8").tobytes())
        self.bytes += len(block)
        self.records += len(ids)
        self.tokens += int(sizes.sum())

    def close(self) -> tuple:
        self.data.close()
        self.index.close()
        return self.name, self.bytes, self.records, self.tokens


def _blocks(batches, most: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a few rows at a time, up to some characters or a single row."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for name, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                if ids and size + len(text) > most:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(name)
                texts.append(text)
                size += len(text)
    if ids:
        yield ids, texts


MANIFEST = "place long, number int, file string, bytes long, records long, tokens long"


def write_records(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id",
                  text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the token ids of all texts, each with ``end_id`` at its end, in ascending order of their ids.

    Returns the manifest, a row per file in their order: place and number, file
    (its name without ending), bytes, records, tokens and first_token (tokens of
    all files before it). It is also written to ``folder``. NULL texts are
    empty, rows with a NULL id come first, and rows of one id stand in the order
    of their texts' hashes. An empty table gives no files.

    Texts are range partitioned by id, so that a task writes a range; an id with
    many rows is split too. Files have names of their own, and the manifest
    names those of tasks that ended, so a task may be run again.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("spread")]
    # Equal rows are spread by a last key; which of them comes first makes no difference.
    placed = plain.withColumn("spread", F.rand(11)).repartitionByRange(*order) \
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text", "spread").select("id", "text")

    def write(batches):
        place = TaskContext.get().partitionId()
        encoder = per_worker(("bpe", path), lambda: Encoder(path))
        width = 2 if encoder.vocabulary.size <= 1 << 16 else 4
        file, made = None, []
        for ids, texts in _blocks(batches, min(BLOCK_CHARS, file_bytes)):
            file = file or _File(folder, place)
            file.add(ids, [np.append(t, np.int32(end_id)) for t in encoder.encode(texts)], width)
            if file.bytes >= file_bytes:
                made.append((place, len(made), *file.close()))
                file = None
        if file:
            made.append((place, len(made), *file.close()))
        if made:
            names = ["place", "number", "file", "bytes", "records", "tokens"]
            types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    # The folder must exist on stores that have folders; Spark makes it with the manifest.
    spark = docs.sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{folder}/made")
    made = materialise(placed.mapInArrow(write, MANIFEST), "manifest")
    # One row per file: a single window is small at any size of the corpus.
    before = Window.orderBy("place", "number").rowsBetween(Window.unboundedPreceding, -1)
    made.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0))) \
        .coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder of records that count."""
    return spark.read.schema(f"{MANIFEST}, first_token long").parquet(f"{folder}/manifest")


def locations(spark: SparkSession, folder: str) -> DataFrame:
    """Where every record lies, from the indexes alone: (file, row, offset, end, start).

    ``start`` counts the tokens of all records before it. Indexes are read by as many tasks as there are files.
    """
    return _files(spark, folder).mapInArrow(_index_reader(folder), "file string, row long, offset long, end long, start long")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, dealt to as many tasks."""
    files = manifest(spark, folder).select("file", "bytes", "records", "first_token")
    return files.repartitionByRange(max(1, min(files.count(), 10_000)), "file")


def _index_reader(folder: str):
    def block(file, row, own, end, first):
        """All entries of ``own`` but the last, which only ends another; the last too if its end is given."""
        ends = own[1:, 0] if end is None else np.append(own[1:, 0], end)
        own = own[:len(ends)]
        n = len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n), pa.array(np.arange(row, row + n)), pa.array(own[:, 0]), pa.array(ends), pa.array(own[:, 1] + first)],
            names=["file", "row", "offset", "end", "start"])

    def read(batches):
        for batch in batches:
            for file, size, records, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                store, base = _open(folder)
                with store.open_input_stream(f"{base}/{file}.index") as stream:
                    row, held = 0, None
                    while row < records:
                        # The last entry of a block waits for the next one, which says where it ends.
                        own = np.frombuffer(stream.read(16 * min(16_384, records - row)), "<u8").reshape(-1, 2).astype(np.int64)
                        if held is not None:
                            yield block(file, row - 1, np.concatenate([held, own[:1]]), None, first)
                        if len(own) > 1:
                            yield block(file, row, own, None, first)
                        held, row = own[-1:], row + len(own)
                    yield block(file, records - 1, held, size, first)
    return read


def fetch(places: DataFrame, folder: str) -> DataFrame:
    """Read records in the order in which a table of ``locations`` names them: (doc_id, start, tokens).

    Runs of neighbouring records are read at once. Every checksum is verified; a record that does not agree
    ends the query with Corrupt.
    """
    return places.select("file", "row", "offset", "end", "start") \
        .mapInArrow(_record_reader(folder), "doc_id long, start long, tokens array<int>")


def _record_reader(folder: str):
    def read(batches):
        streams = {}
        store, base = _open(folder)
        for batch in batches:
            file, _, offset, end, start = (batch.column(i).to_pylist() for i in range(5))
            i = 0
            while i < len(file):
                j = i + 1
                while j < len(file) and file[j] == file[i] and offset[j] == end[j - 1] and end[j] - offset[i] <= READ_BYTES:
                    j += 1
                if file[i] not in streams:
                    if len(streams) >= 64:
                        streams.pop(next(iter(streams))).close()
                    streams[file[i]] = store.open_input_file(f"{base}/{file[i]}.records")
                raw = streams[file[i]].read_at(end[j - 1] - offset[i], offset[i])
                names, tokens = zip(*unframe(raw, np.array(offset[i:j], np.int64) - offset[i]))
                bounds = np.cumsum([0, *map(len, tokens)])
                flat = pa.array(np.concatenate(tokens).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(start[i:j], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)],
                    names=["doc_id", "start", "tokens"])
                i = j
        for stream in streams.values():
            stream.close()
    return read


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """All records in an order that a seed decides: only index entries are shuffled, then each record is sought."""
    places = locations(spark, folder)
    mixed = F.xxhash64(F.lit(seed), "file", "row")
    return fetch(places.repartitionByRange(mixed).sortWithinPartitions(mixed), folder)


def described(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Write all texts as records and describe what the files hold.

    Returns a row per document: doc_id, start (tokens of all documents before
    it), n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit
    integers), read back from the files. See ``write_records`` for NULLs and
    order; repeated rows are records each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    write_records(docs, path, folder, end_id, id_col, text_col)

    indexes, records = _index_reader(folder), _record_reader(folder)

    def describe(batches):
        # One function, so that a task needs one Python worker.
        for batch in records(indexes(batches)):
            tokens = batch.column(2)
            bounds, flat = np.asarray(tokens.offsets), np.asarray(tokens.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _files(spark, folder).mapInArrow(describe, "doc_id long, start long, n_tokens long, ids_crc32 long") \
        .withColumnRenamed("doc_id", id_col)
