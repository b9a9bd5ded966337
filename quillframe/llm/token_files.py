"""Token files (operator 7): independent zstandard frames, a trailing seek table, a checksum per frame.

File layout, after the public zstandard seekable format:

    frame 0 .. frame n-1     ids as little-endian unsigned 32-bit integers; a frame holds whole documents
    skippable frame 5D       the document index: a zstandard frame of doc_id, null flag, ids, frame per document
    skippable frame 5E       the seek table: per frame its compressed size, plain size and checksum (low 32
                             bits of XXH64 of the plain bytes), then frame count, flags, magic number

A reader takes the last bytes, the table and the index, and decompresses the frames of the documents it
wants and no others. Any zstandard decoder reads the whole file as one stream of ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.byte_tokens import byte_tokens
from quillframe.llm.common import delete_at_end, prepare, shared_folder

# fixed values of the public format
SEEK_MAGIC, TABLE_FRAME, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
END_ID = 2
FRAME_BYTES = 128 << 10
LEVEL = 3
PIECE_BYTES = 1 << 30
#: Text that goes to a file at about, where the session's shuffle partitions are fewer than that makes.
FILE_BYTES = 1 << 28
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u8"), ("frame", "<u4")])


class Writer:
    """Writes documents in the order they come. Memory: one frame, and 21 bytes a document.

    A frame holds whole documents up to ``frame_bytes``, or one longer document; one of over ``piece_bytes`` goes on in further frames,
    as the format counts a frame's bytes in 32 bits.
    """

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, piece_bytes: int = PIECE_BYTES):
        self.sink, self.frame_bytes, self.piece_bytes = sink, frame_bytes, piece_bytes
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index = np.zeros(1024, ENTRY)
        self.n_docs = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype("<u4", copy=False).tobytes()
        if self.held and self.n_held + len(data) > self.frame_bytes:
            self._frame()
        if self.n_docs == len(self.index):
            self.index = np.concatenate([self.index, np.zeros_like(self.index)])
        self.index[self.n_docs] = (doc_id or 0, doc_id is None, len(ids), len(self.frames))
        self.n_docs += 1
        for at in range(0, max(1, len(data)), self.piece_bytes):
            if at:
                self._frame()
            self.held.append(data[at : at + self.piece_bytes])
            self.n_held += len(self.held[-1])
        self.n_ids += len(ids)

    def _frame(self) -> None:
        plain = b"".join(self.held)
        packed = self.pack.compress(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = self.pack.compress(self.index[: self.n_docs].tobytes())
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_FRAME, len(table)) + table)
        self.sink.close()


class Reader:
    """Random access to one file; ``source`` has read(n), seek(at) and size()."""

    def __init__(self, source):
        self.source = source
        self.unpack = zstandard.ZstdDecompressor()
        self.decompressed = 0
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable file with checksums")
        table = end - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])]).astype(np.int64)
        kind, size = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if kind != INDEX_FRAME:
            raise ValueError("the document index is missing")
        index = self.unpack.decompress(self._at(int(self.starts[-1]) + 8, size)) if size else b""
        self.index = np.frombuffer(index, ENTRY)
        total = np.cumsum(self.index["ids"], dtype=np.int64)
        self.before = total - self.index["ids"].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1] // 4)])

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        size, plain_size, check = self.frames[k]
        plain = self.unpack.decompress(self._at(int(self.starts[k]), int(size)), max_output_size=max(1, int(plain_size)))
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum mismatch")
        self.decompressed += 1
        return np.frombuffer(plain, "<u4")

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids before it in the file, its ids; of all documents or those index rows."""
        held, ids = -1, None
        for row in range(len(self.index)) if rows is None else rows:
            doc_id, null, n, frame = self.index[row]
            if frame != held:
                held, ids = int(frame), self.frame(int(frame))
            at = int(self.before[row] - self.first[held])
            found = ids[at : at + int(n)]
            while len(found) < n:
                held += 1
                ids = self.frame(held)
                found = np.concatenate([found, ids[: int(n) - len(found)]])
            yield (None if null else int(doc_id)), int(self.before[row]), found

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """The named documents; only their frames are decompressed."""
        wanted = np.isin(self.index["doc_id"], np.array(list(doc_ids), dtype=np.int64)) & (self.index["null"] == 0)
        return self.documents(np.flatnonzero(wanted))


def open_sink(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write(spark: SparkSession, docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes one file per range of doc_id, ranges and rows ascending; gives file, ids_before, n_ids, n_docs.

    Range partitioning deals out the documents; a file is written under a name of the attempt and then
    moved, so a task that runs again leaves one whole file. Only one row a file comes to the driver.
    """
    prepare(spark)
    uri = (folder or shared_folder(spark)).rstrip("/") + f"/token-files-{uuid.uuid4().hex}"
    if folder is None:
        delete_at_end(spark, uri)
    if uri.startswith("/"):
        uri = "file://" + uri
    system, at = open_sink(uri)
    system.create_dir(at, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        tokens = byte_tokens(path)
        writer = None
        system, at = open_sink(uri)
        name = f"{at}/part-{context.partitionId():06d}.zst"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    system.create_dir(at, recursive=True)
                    writer = Writer(system.open_output_stream(f"{name}.{context.taskAttemptId()}"), frame_bytes)
                writer.add(doc_id, np.append(tokens.encode(text or ""), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            system.move(f"{name}.{context.taskAttemptId()}", name)
            row = [context.partitionId(), f"{uri}/part-{context.partitionId():06d}.zst", writer.n_ids, writer.n_docs]
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("part", "file", "n_ids", "n_docs"), row)})

    size = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # the plan's estimate of the size; unknown sizes are given as enormous ones
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES if size < 1 << 60 else 0)
    # rows of one doc_id are in the order of their texts, so a hot id (null, say) falls into several ranges and every run gives the same files
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    dealt = docs.select("doc_id", "text").repartitionByRange(n, *order[:2])
    files = dealt.sortWithinPartitions(*order).mapInArrow(run, "part long, file string, n_ids long, n_docs long").collect()
    rows, before = [], 0
    for f in sorted(files, key=lambda f: f["part"]):
        rows.append((f["file"], before, f["n_ids"], f["n_docs"]))
        before += f["n_ids"]
    schema = "file string, ids_before long, n_ids long, n_docs long"
    return spark.createDataFrame(rows, schema).repartition(max(1, len(rows)), "file") if rows else spark.createDataFrame([], schema)


def read(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32. Each frame's checksum is verified."""

    def run(batches):
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = open_sink(uri)
                reader = Reader(system.open_input_file(at))
                out: list[tuple] = []
                for doc_id, start, ids in reader.documents():
                    out.append((doc_id, before + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return files.select("file", "ids_before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)


def write_and_read(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Operator 7: encode, write in ascending doc_id, read back.

    Null text is empty (its end id alone). Null doc_ids come first. Rows of one doc_id stand in the order
    of a digest of their texts, equal rows side by side. An empty table writes no file and gives no rows. Other columns are not read.
    """
    return read(write(spark, docs, path=path))
