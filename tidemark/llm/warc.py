"""WARC archives: a Spark data source that reads them, and a writer with revisits.

Reading (`spark.read.format("warc").load(path)`): archives are planned into
partitions of about equal bytes (a file is never split, as gzip members can't be
found from inside). Filters on `record_type` and other header columns are pushed to
the reader, which parses the header of a record first and skips the block of a
record that is filtered out. Payload columns are decoded only where they are asked
for: leave out `payload` and what is derived from it with `.option("payload",
"none")`, or get length and digest without the bytes with `"digest"`.

Writing (`df.write.format("warc")`): each task writes archives of a bounded size,
one gzip member a record, under names of its own; the commit of the job renames
them into place, so a lost attempt leaves nothing that is read.

Defined cases: a null html is an empty payload; a row with a null page_id is a
response that nothing refers to; rows that share page_id and payload are all
responses where that id is the smallest; a null url is left out of the header; an
empty table writes no archive and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from tidemark.llm.shared import filesystem, prepare
from tidemark.storage import scratch_dir

#: Payloads of fewer bytes are always responses.
REVISIT_BYTES = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Archives are read in partitions of about so many bytes.
PARTITION_BYTES = 64 << 20

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary"
)
#: Columns known from the header alone, and the header that gives each.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}


# -- records ---------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page it refers to (which has the HTTP header but no payload)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_ID}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(url.split("\r")).replace("\n", "%0A")))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _header_lines(stream) -> dict[str, str]:
    """Headers up to the empty line; names in lower case."""
    found: dict[str, str] = {}
    name = ""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            break
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:
            found[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def records(stream, wanted) -> Iterator[tuple[dict[str, str], io.BufferedIOBase | None]]:
    """(headers, stream at the block) of the records that `wanted(headers)` picks; other blocks are passed over.

    The caller reads from the stream what it likes of a block.
    """
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = _header_lines(stream)
        block = _Block(stream, int(headers.get("content-length", "0")))
        if wanted(headers):
            yield headers, block
        block.skip()


class _Block:
    """The block of a record within its stream."""

    def __init__(self, stream, size: int):
        self.stream, self.left = stream, size

    def read(self, size: int) -> bytes:
        data = self.stream.read(min(size, self.left))
        if not data and self.left and size:
            raise EOFError("a record ends early")
        self.left -= len(data)
        return data

    def readline(self) -> bytes:
        line = self.stream.readline(self.left)
        self.left -= len(line)
        return line

    def skip(self) -> None:
        while self.left:
            self.read(1 << 20)


# -- the reader ------------------------------------------------------------------------------------------------------


class Archives(InputPartition):
    def __init__(self, paths: Sequence[str]):
        super().__init__(tuple(paths))


def _list(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives below a folder, or of a single one."""
    from pyarrow import fs as arrow_fs

    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(root, info.size)]
    found = fs.get_file_info(arrow_fs.FileSelector(root, recursive=False))
    return sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and x.base_name[0] not in "._")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        if payload not in ("bytes", "digest", "none"):
            raise ValueError("the option payload is one of bytes, digest, none")
        self.path, self.payload = path, payload
        self.conditions: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality with texts on header columns is decided here; all else is left to Spark."""
        for condition in filters:
            column = getattr(condition, "attribute", ())
            if len(column) == 1 and column[0] in HEADERS:
                if isinstance(condition, EqualTo):
                    self.conditions.append((HEADERS[column[0]], frozenset([condition.value])))
                    continue
                if isinstance(condition, In):
                    self.conditions.append((HEADERS[column[0]], frozenset(condition.value)))
                    continue
                if isinstance(condition, IsNotNull) and column[0] in ("record_type", "record_id"):
                    continue
            yield condition

    def partitions(self) -> list[InputPartition]:
        groups, size = [], PARTITION_BYTES
        for path, length in _list(self.path):
            if size >= PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += length
        return [Archives(paths) for paths in groups] or [Archives(())]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(name, "").strip("<>") in values for name, values in self.conditions)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows, size = [], 0
        for path in partition.value:
            with fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as raw:
                for headers, block in records(io.BufferedReader(raw, 1 << 20), self.wanted):
                    row = self._row(headers, block)
                    rows.append(row)
                    size += 300 + len(row[-1] or b"")
                    if size > 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, headers: dict[str, str], block: _Block) -> tuple:
        known = [headers[name].strip("<>") if name in headers else None for name in HEADERS.values()]
        stated = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if self.payload == "none":
            return *known, None, stated, None
        length = None
        if headers.get("content-type", "").startswith("application/http"):
            block.readline()
            http = _header_lines(block)
            length = int(http["content-length"]) if "content-length" in http else None
        if headers.get("warc-type") == "revisit":
            return *known, length, stated, None
        digest, parts, count = hashlib.sha256(), [], 0
        while data := block.read(1 << 20):
            digest.update(data)
            count += len(data)
            if self.payload == "bytes":
                parts.append(data)
        found = digest.hexdigest()
        if stated and headers.get("warc-payload-digest", "").startswith("sha256:") and stated != found:
            raise ValueError(f"the payload of {headers.get('warc-record-id')} does not match its digest")
        return *known, count, found, b"".join(parts) if self.payload == "bytes" else None

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
        names = [*HEADERS, "payload_bytes", "payload_digest", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


# -- the writer ------------------------------------------------------------------------------------------------------


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Columns page_id, url, html (binary), digest, refers_to."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        names, sink, size = [], None, 0
        task = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        for batch in iterator:
            columns = (batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    names.append(f".{self.job}-{task:06d}-{attempt}-{len(names):04d}.warc.gz")
                    sink, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(page_id, url, html or b"", digest, refers_to))
                sink.write(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                fs.move(f"{root}/{name}", f"{root}/{name[1:]}")

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for message in messages:
            for name in message.names if message else ():
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "bytes"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added")
        return WarcWriter(self.options["path"], uuid.uuid4().hex[:8])


def register(spark: SparkSession) -> SparkSession:
    """Make `warc` a format of the session and let Spark push filters to it."""
    prepare(spark).dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_pages(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> None:
    """A record for each row of (page_id, url, html); equal payloads become revisits of the smallest page_id."""
    register(pages.sparkSession)
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_enough = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    # only payloads that are there twice; partial sums come before the shuffle
    first = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(first.select("digest", "first"), "digest", "left")
    refers_to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    joined.select("page_id", "url", "html", "digest", refers_to.alias("refers_to")).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str, payload: str = "digest") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of each record of `write_pages`."""
    archives = register(spark).read.format("warc").option("payload", payload).load(folder)
    number = lambda c: F.when(F.col(c).startswith(_ID), F.substring(c, len(_ID) + 1, 20).cast("long"))
    return archives.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "payload"
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages to new archives and read those back."""
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    write_pages(pages, folder)
    return read_pages(spark, folder)
