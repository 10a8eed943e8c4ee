"""Token ids in files of independent zstandard frames with a seek table at the end.

A file is plain zstandard (any decoder reads it): data frames of little-endian
unsigned 32-bit ids, then a skippable frame with the document index (ids and
starts, compressed), then the seek table of the seekable format, with sizes and
an XXH64 checksum for each frame. A frame ends after the first document that
fills it, longer documents run over several frames; a reader opens only the
frames of the documents it was asked for.

Files are in ascending doc_id order: one range of ids each, sorted inside. Every
attempt of a task writes a file of its own name, and only those listed in the
manifest, which Spark commits, are read.

Defined cases: a null text is an empty document of one id (the end id); rows
with a null doc_id come first; rows with equal doc_id are ordered by a hash of the text; an
empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import filesystem, parallelism, slices, unique_name
from tidemark.llm.tokens import END, encoder
from tidemark.storage import scratch_dir

#: Fixed values of the seekable zstandard format.
SKIPPABLE, SEEK_TABLE, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

#: Ids of a frame, unless a document ends later.
FRAME_IDS = 1 << 16

MANIFEST = "part int, path string, documents long, tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
CHECKSUMMED = "doc_id long, start long, n_tokens long, ids_crc32 long"


class TokenFileWriter:
    """Writes documents one after another; holds one frame and the index."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 1):
        self.sink, self.frame_bytes = sink, 4 * frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.buffer = bytearray()
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        for at in range(0, len(ids), self.frame_bytes):
            self.buffer += ids[at : at + self.frame_bytes]
            if len(self.buffer) >= self.frame_bytes:
                self._end_frame()

    def _end_frame(self) -> None:
        if self.buffer:
            data = bytes(self.buffer)
            frame = self.compressor.compress(data)
            self.sink.write(frame)
            self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.buffer.clear()

    def close(self) -> None:
        self._end_frame()
        known = np.array([doc_id is not None for doc_id in self.doc_ids], "u1")
        doc_ids = np.array([doc_id or 0 for doc_id in self.doc_ids], "<i8")
        index = struct.pack("<Q", len(known)) + np.array(self.starts, "<i8").tobytes() + doc_ids.tobytes() + known.tobytes()
        packed = self.compressor.compress(index)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.table.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(footer)) + entries + footer)


class TokenFile:
    """Reads the tail of a file at once and frames on request."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, kind, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_FOOTER or kind != CHECKSUMS:
            raise ValueError("the file has no seek table")
        table = np.frombuffer(self._read(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype("i8")
        self.sums = table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.first_id = np.concatenate([[0], np.cumsum(table[:-1, 1] // 4)])
        index = self._checked(zstandard.decompress(self._read(int(self.at[-2]) + 8, int(table[-1, 0]) - 8)), count - 1)
        n = struct.unpack_from("<Q", index)[0]
        self.starts = np.frombuffer(index, "<i8", n + 1, 8)
        known = np.frombuffer(index, "u1", n, 8 + 8 * (2 * n + 1))
        ids = np.frombuffer(index, "<i8", n, 8 + 8 * (n + 1))
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]

    def _read(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at)

    def _checked(self, data: bytes, frame: int) -> bytes:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"frame {frame} does not match its checksum")
        return data

    def frame(self, number: int) -> bytes:
        start, end = int(self.at[number]), int(self.at[number + 1])
        return self._checked(zstandard.decompress(self._read(start, end - start)), number)

    def documents(self, positions: Sequence[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(position, ids) of the documents at ascending positions, or of all; each frame is read once."""
        number, data = -1, b""
        for position in range(len(self.doc_ids)) if positions is None else positions:
            start, end = int(self.starts[position]), int(self.starts[position + 1])
            parts, at = [], start
            while at < end:
                wanted = int(np.searchsorted(self.first_id, at, "right")) - 1
                if wanted != number:
                    number, data = wanted, self.frame(wanted)
                first = int(self.first_id[number])
                parts.append(data[4 * (at - first) : 4 * (end - first)])
                at = min(end, first + len(data) // 4)
            yield position, b"".join(parts)


def write_token_files(documents: DataFrame, tokenizer: str, folder: str | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write the token ids of (doc_id, text) and return the committed manifest, one row a file.

    The texts are sorted by ranges of doc_id (one shuffle, which spills); ids are
    made and written in the same task, so they are never shuffled.
    """
    spark = documents.sparkSession
    folder = folder or scratch_dir(spark, "tokens")

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        encode, sink, writer, path = encoder(tokenizer), None, None, None
        for batch in batches:
            for some in slices(batch, 2 << 20):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/{unique_name(f'part-{part:06d}', '.ids.zst')}"
                    sink = fs.open_output_stream(path, compression=None)
                    writer = TokenFileWriter(sink, frame_ids)
                for doc_id, ids in zip(some["doc_id"].to_pylist(), encode(some["text"].to_pylist()), strict=True):
                    writer.add(doc_id, ids + END)
        if writer is not None:
            writer.close()
            sink.close()
            row = [part], [path], [len(writer.doc_ids)], [int(writer.starts[-1])]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], ["part", "path", "documents", "tokens"])

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # rows of one doc_id (or of none) may be many: a hash of the text parts them, too
        .withColumn("print", F.xxhash64("text"))
        .repartitionByRange(parallelism(spark), F.col("doc_id").asc_nulls_first(), "print")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "print", "text")
        .drop("print")
    )
    manifest = f"{folder}/manifest.parquet"
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_token_files(manifest: DataFrame, folder: str, doc_ids: Sequence[int] | None = None, checksums: bool = False) -> DataFrame:
    """Documents of the files with the place of their first id among all files.

    With `doc_ids` only the frames of those documents are read. With `checksums` the
    ids stay in the reader, and their crc32 is returned in their place. The manifest
    (a row for each file) is summed up on the driver.
    """
    spark = manifest.sparkSession
    base, files = 0, []
    for row in sorted(manifest.collect(), key=lambda row: row.part):
        files.append((row.path, base))
        base += row.tokens
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def read(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    yield from rows(TokenFile(source), first)

    def rows(file: TokenFile, first: int):
        picked = None if wanted is None else [i for i, doc_id in enumerate(file.doc_ids) if doc_id in wanted]
        found, size = [], 0
        for position, ids in file.documents(picked):
            found.append((file.doc_ids[position], first + int(file.starts[position]), len(ids) // 4, zlib.crc32(ids) if checksums else ids))
            size += 0 if checksums else len(ids)
            if size > 4 << 20 or len(found) >= 5_000:
                yield arrow(found)
                found, size = [], 0
        if found:
            yield arrow(found)

    def arrow(found):
        doc_ids, starts, lengths, ids = zip(*found, strict=True)
        columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.int64() if checksums else pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32" if checksums else "ids"])

    listed = spark.createDataFrame(files, "path string, base long")
    return listed.repartition(max(1, len(files))).mapInArrow(read, CHECKSUMMED if checksums else DOCUMENTS)


def write_and_read(documents: DataFrame, tokenizer: str, checksums: bool = False) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids (or their checksums)."""
    spark: SparkSession = documents.sparkSession
    folder = scratch_dir(spark, "tokens")
    return read_token_files(write_token_files(documents, tokenizer, folder), folder, checksums=checksums)


