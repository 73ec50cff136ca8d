"""Token ids in seekable compressed files (operator 3).

A file is a run of independent zstandard frames and two skippable frames after them. A frame holds the ids of one or
more whole documents, little-endian unsigned 32-bit. The first skippable frame lists the documents (id, frame, offset
and length in ids there); the last one is the seek table of the public zstandard seekable format: for each frame its
compressed size, its size and the low half of its XXH64, then the number of frames, a flag byte and a magic number. A
reader takes the table from the file's end and decompresses only the frames of the documents asked for.

Writing deals documents out by ranges of doc_id, so that files in order hold documents in ascending doc_id order, with
a null doc_id first and rows of equal doc_id by text. Each task writes one file under a name of its own attempt and
returns one row on it; those rows are stored by Spark's committer, so a repeated or lost task leaves at most a file
that nobody reads. Null text has no ids but the end id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import persisted, shared_path, text_bytes

#: Fixed values of the public format.
SKIPPABLE_DOCUMENTS = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: Ids after which a frame is closed, always at a document's end.
FRAME_IDS = 1 << 16
FILE_SCHEMA = "file_no long, path string, n_docs long, n_tokens long, n_frames long, n_bytes long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, file_no long, frame_no long"
_DOC = struct.Struct("<?qIIQ")
_SEEK = struct.Struct("<III")


def filesystem(uri: str):
    """The Arrow filesystem and the path in it of a shared folder's URI."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Writes one file to an open stream: `add` per document in order, then `close`."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self._stream, self._frame_bytes = stream, 4 * frame_ids
        self._compress = zstandard.ZstdCompressor(level=level).compress
        self._held: list[bytes] = []
        self._held_bytes = 0
        self._docs, self._seek = bytearray(), bytearray()
        self.n_docs = self.n_tokens = self.n_frames = self.n_bytes = 0

    def _put(self, data: bytes) -> None:
        self._stream.write(data)
        self.n_bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs += _DOC.pack(doc_id is not None, doc_id or 0, self.n_frames, self._held_bytes // 4, len(ids) // 4)
        self._held.append(ids)
        self._held_bytes += len(ids)
        self.n_docs += 1
        self.n_tokens += len(ids) // 4
        if self._held_bytes >= self._frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        import xxhash

        data = b"".join(self._held)
        packed = self._compress(data)
        self._seek += _SEEK.pack(len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
        self._put(packed)
        self.n_frames += 1
        self._held, self._held_bytes = [], 0

    def close(self) -> None:
        if self._held:
            self._end_frame()
        docs = self._compress(bytes(self._docs))
        docs += struct.pack("<II", len(docs), len(self._docs))  # last, so that it is found from the file's end
        self._put(struct.pack("<II", SKIPPABLE_DOCUMENTS, len(docs)) + docs)
        table = bytes(self._seek) + struct.pack("<IBI", self.n_frames, HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class FileReader:
    """Reads a file by its tables. `source` is a seekable binary stream."""

    def __init__(self, source):
        source.seek(0, 2)
        size = source.tell()
        if size < 9:
            raise ValueError("the file is too short")
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("the file doesn't end in a seek table with checksums")
        table_at = size - 9 - n * _SEEK.size - 8
        source.seek(table_at - 8)
        head = source.read(16 + n * _SEEK.size)
        docs_size, docs_bytes = struct.unpack_from("<II", head)
        self._source, self._frames, at = source, [], 0
        for packed, plain, check in _SEEK.iter_unpack(head[16:]):
            self._frames.append((at, packed, plain, check))
            at += packed
        source.seek(table_at - 8 - docs_size)
        import zstandard

        self._expand = zstandard.ZstdDecompressor().decompress
        listed = self._expand(source.read(docs_size), max_output_size=docs_bytes) if docs_bytes else b""
        #: (doc_id, frame, offset in ids, length in ids) in the file's order.
        self.documents = [(d if there else None, f, o, k) for there, d, f, o, k in _DOC.iter_unpack(listed)]

    def frame(self, k: int) -> bytes:
        """One frame's ids, checked."""
        import xxhash

        at, packed, plain, check = self._frames[k]
        self._source.seek(at)
        data = self._expand(self._source.read(packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, wanted: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) of the documents wanted; only their frames are read."""
        wanted, held, data = {*wanted}, -1, b""
        for doc_id, k, offset, length in self.documents:
            if doc_id in wanted:
                if k != held:
                    held, data = k, self.frame(k)
                yield doc_id, data[4 * offset : 4 * (offset + length)]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encodes `docs` (doc_id, text; other columns are ignored) into files under `folder`; returns a row per file."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")

    def write(batches):
        import pyarrow as pa

        from lectern.llm.tokenizing import encoder

        encode, end = encoder(tokenizer_path).encode, struct.pack("<I", end_id)
        fs, base = filesystem(folder)
        part, writer = TaskContext.get().partitionId(), None
        path = f"{base}/{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(base, recursive=True)
                stream = fs.open_output_stream(path, compression=None)
                writer = FileWriter(stream, frame_ids)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                writer.add(doc_id, encode([text])[0] + end)
        if writer:
            writer.close()
            stream.close()
            row = {"file_no": part, "path": path, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_frames": writer.n_frames, "n_bytes": writer.n_bytes}
            yield pa.RecordBatch.from_pylist([row])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = persisted(dealt.mapInArrow(write, FILE_SCHEMA), "files")
    return files.withColumn("folder", F.lit(folder))


def read_token_files(files: DataFrame) -> DataFrame:
    """A row per document in `files`, read back from them: doc_id, start, n_tokens, ids_crc32, file_no, frame_no.

    `start` counts the ids of all documents before it; the sum over files runs over one row a file."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n_files = max(1, files.count())

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                with fs.open_input_file(row["path"]) as source:
                    reader, start, held, data, out = FileReader(source), row["base"], -1, b"", []
                    for doc_id, k, offset, length in reader.documents:
                        if k != held:
                            held, data = k, reader.frame(k)
                        crc = zlib.crc32(memoryview(data)[4 * offset : 4 * (offset + length)])
                        out.append({"doc_id": doc_id, "start": start, "n_tokens": length, "ids_crc32": crc, "file_no": row["file_no"], "frame_no": k})
                        start += length
                yield pa.RecordBatch.from_pylist(out)

    return placed.repartitionByRange(n_files, "file_no").mapInArrow(read, DOC_SCHEMA)


def fetch_documents(files: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids array) of the documents in `doc_ids` (doc_id), reading only the frames that hold them."""
    places = read_index(files).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def fetch(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                with fs.open_input_file(row["path"]) as source:
                    for doc_id, ids in FileReader(source).ids(row["wanted"]):
                        yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "ids": np.frombuffer(ids, "<u4").tolist()}])

    # One row for each document, so that no list of a file's documents is gathered.
    return places.select("folder", "path", F.array("doc_id").alias("wanted")).mapInArrow(fetch, "doc_id long, ids array<long>")


def read_index(files: DataFrame) -> DataFrame:
    """(doc_id, folder, path) of every document, from the files' own lists; no frame is decompressed."""

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                with fs.open_input_file(row["path"]) as source:
                    out = [{"doc_id": d[0], "folder": row["folder"], "path": row["path"]} for d in FileReader(source).documents]
                yield pa.RecordBatch.from_pylist(out)

    return files.repartitionByRange(max(1, files.count()), "file_no").mapInArrow(listed, "doc_id long, folder string, path string")
