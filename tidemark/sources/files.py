"""Directories of CSV, JSON, Avro or Parquet files as one table."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark import storage
from tidemark.operators.changes import EPOCH
from tidemark.operators.schemas import merge_schemas

# Microsecond timestamps survive text formats only with these.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# Spark 4 carries the Avro file format in its SQL module; the short name needs
# the spark-avro module on the class path.
_AVRO_CLASS = "org.apache.spark.sql.avro.AvroFileFormat"


def format_name(spark: SparkSession, filetype: str) -> str:
    """The data source name of a file type; ValueError for an unknown one."""
    if filetype in ("csv", "json", "parquet"):
        return filetype
    if filetype != "avro":
        raise ValueError(f"file type must be csv, json, avro or parquet, not {filetype!r}")
    return _AVRO_CLASS


def text_options(filetype: str) -> dict[str, str]:
    """Options shared by reading and writing, so a round trip is exact."""
    if filetype == "csv":
        keep_spaces = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        return {"header": "true", "escape": '"', **keep_spaces, **TIME_FORMATS}
    if filetype == "json":
        return dict(TIME_FORMATS)
    return {}


def read_options(filetype: str) -> dict[str, str]:
    options = text_options(filetype)
    if filetype in ("csv", "json"):
        options["mode"] = "FAILFAST"
    if filetype == "csv":
        # an empty cell is null, a quoted empty one is an empty text
        options["nullValue"] = "\u0000"
        # texts may hold line breaks; `multi_line` of a source says when they do
        # not, so that large files can be split
        options["multiLine"] = "true"
        # headers are compared with the schema: a file with other columns, or
        # with columns in another order, fails the read
        options["enforceSchema"] = "false"
    return options


def widen_integers(schema: T.StructType) -> T.StructType:
    """Inferred 32-bit integers as 64-bit ones."""
    return T.StructType(
        [
            T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType, f.nullable)
            for f in schema
        ]
    )


def is_new(bookmark: datetime) -> Column:
    """True for rows of files modified strictly after the bookmark.

    The column is constant per file, so whole files are left out of the scan.
    """
    if bookmark.tzinfo is None:
        bookmark = bookmark.replace(tzinfo=timezone.utc)
    micros = round((bookmark - EPOCH).total_seconds() * 1_000_000)
    return F.col("_metadata.file_modification_time") > F.timestamp_micros(F.lit(micros))


# Some thousand years: no file is too old to be new.
ANY_AGE = "365000d"


@dataclass(frozen=True)
class FileSource:
    """A directory that holds one table as files.

    The directory is read flat. `schema` is inferred from all files of a read
    when not given, so later files may bring further columns; a given one is
    frozen. `on_fail` is `stop` (an unreadable file ends this source) or `skip`
    (the unreadable file is left out and reported). `multi_line=False` promises
    that no text of a CSV file holds a line break: large files are then read by
    many tasks. `max_file_age` is how far a file may be behind the newest one and
    still count as new; by default any age does, and the checkpoint keeps the name
    of every file seen (some hundred bytes each), a limit lets it forget old ones.
    """

    name: str
    path: str
    filetype: str = "csv"
    schema: T.StructType | None = None
    bookmark: datetime = EPOCH
    poll_interval_ms: int = 10_000
    on_fail: str = "stop"
    one_request: bool = False
    max_files_per_trigger: int = 1_000
    options: dict[str, str] = field(default_factory=dict)
    multi_line: bool = True
    max_file_age: str = ANY_AGE

    def read_options(self) -> dict[str, str]:
        """The source's own options and what its fields say."""
        lines = {} if self.filetype != "csv" else {"multiLine": str(self.multi_line).lower()}
        return {**lines, **self.options}

    def resolve_schema(self, spark: SparkSession) -> T.StructType:
        if self.schema is not None:
            return self.schema
        return infer_schema(spark, self.path, self.filetype, self.read_options())


def infer_schema(
    spark: SparkSession, path: str | list[str], filetype: str = "csv", options: dict[str, str] | None = None
) -> T.StructType:
    """Infer a table's schema from all files of a directory, or from all files given.

    Texts are read by Spark for it, of Parquet and Avro files only the footers or
    heads. Columns that only some files have join at the end.
    """
    if isinstance(path, str):
        names = [n for n in storage.list_names(spark, path) if not n.startswith(("_", "."))]
        if not names:
            raise FileNotFoundError(f"no files to infer a schema from in {path}")
        files = [f"{path.rstrip('/')}/{n}" for n in names]
    else:
        files = path
    reader = spark.read.format(format_name(spark, filetype)).options(**read_options(filetype)).options(**(options or {}))
    if filetype == "avro":
        # the format takes the schema of one file; equal ones are merged only once
        with ThreadPoolExecutor(8) as pool:
            found = {schema.json(): schema for schema in pool.map(lambda file: reader.load(file).schema, files)}
        return reduce(merge_schemas, [found[key] for key in sorted(found, key=lambda key: (len(key), key))])
    if filetype == "csv":
        return widen_integers(reader.option("inferSchema", "true").load(path).schema)
    if filetype == "parquet":
        reader = reader.option("mergeSchema", "true")
    return reader.load(path).schema


def read_files(
    spark: SparkSession,
    path: str | list[str],
    filetype: str = "csv",
    schema: T.StructType | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Files or directories as one table."""
    if schema is None:
        schema = infer_schema(spark, path, filetype, options)
    reader = spark.read.format(format_name(spark, filetype)).options(**read_options(filetype)).schema(schema)
    return reader.options(**(options or {})).load(path)


def read_new_files(spark: SparkSession, source: FileSource) -> tuple[bool, DataFrame]:
    """One poll as a batch: whether there is anything new, and the new rows."""
    if not any(not n.startswith(("_", ".")) for n in storage.list_names(spark, source.path)):
        return False, spark.createDataFrame([], source.schema or T.StructType([]))
    schema = source.resolve_schema(spark)
    table = read_files(spark, source.path, source.filetype, schema, source.read_options())
    rows = table.where(is_new(source.bookmark))
    return not rows.isEmpty(), rows


def stream_files(spark: SparkSession, source: FileSource) -> DataFrame:
    """The stream of rows of new files; the checkpoint remembers files seen."""
    reader = (
        spark.readStream.format(format_name(spark, source.filetype))
        .schema(source.resolve_schema(spark))
        .options(**read_options(source.filetype))
        .options(**source.read_options())
        .option("maxFilesPerTrigger", source.max_files_per_trigger)
        .option("maxFileAge", source.max_file_age)
    )
    rows = reader.load(source.path)
    return rows if source.bookmark <= EPOCH else rows.where(is_new(source.bookmark))


_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def stream_file_names(spark: SparkSession, source: FileSource) -> DataFrame:
    """The stream of new file names, contents unread.

    Used where a batch must be able to leave single unreadable files out: the
    names of one trigger (bounded by `max_files_per_trigger`) are then read as
    an ordinary batch.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema(_LISTING)
        .option("maxFilesPerTrigger", source.max_files_per_trigger)
        .option("maxFileAge", source.max_file_age)
        .load(source.path)
    )
    since = source.bookmark.replace(tzinfo=source.bookmark.tzinfo or timezone.utc)
    micros = round((since - EPOCH).total_seconds() * 1_000_000)
    fresh = F.col("modificationTime") > F.timestamp_micros(F.lit(micros))
    return names.where(fresh).select("path") if micros > 0 else names.select("path")


def split_unreadable(
    spark: SparkSession, paths: list[str], source: FileSource, schema: T.StructType
) -> tuple[list[str], list[str]]:
    """(readable, unreadable) files of a batch whose read has failed.

    Malformed text is found with one scan; files that cannot be opened or
    decoded at all by reading ever smaller halves. Every probe is distributed.
    """
    unreadable: set[str] = set()
    if source.filetype in ("csv", "json"):
        try:
            unreadable = _malformed(spark, paths, source, schema)
        except Exception:  # a file that is no text table at all
            unreadable = set()
    readable: list[str] = []
    pending = [[path for path in paths if path not in unreadable]]
    while pending:
        group = pending.pop()
        if not group:
            continue
        try:
            probe = read_files(spark, group, source.filetype, schema, source.read_options())
            probe.write.format("noop").mode("overwrite").save()
            readable += group
        except Exception:  # any read error marks the group
            if len(group) == 1:
                unreadable.update(group)
            else:
                middle = len(group) // 2
                pending += [group[middle:], group[:middle]]
    return sorted(readable), sorted(unreadable)


def _malformed(spark: SparkSession, paths: list[str], source: FileSource, schema: T.StructType) -> set[str]:
    """Files with at least one row that does not fit the schema."""
    corrupt = "_corrupt_row"
    options = {**source.read_options(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    wide = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType(), True)])
    rows = read_files(spark, paths, source.filetype, wide, options)
    # the hash keeps every column in the scan, so every value is checked
    checked = rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col(corrupt).isNotNull().alias("bad"),
        F.xxhash64(*[f"`{name}`" for name in schema.names]).alias("digest"),
    )
    per_file = checked.groupBy("path").agg(F.max("bad").alias("bad"), F.max("digest").alias("digest"))
    found = {_plain_path(row["path"]) for row in per_file.collect() if row["bad"]}
    return {path for path in paths if _plain_path(path) in found}


def _plain_path(path: str) -> str:
    """A path without scheme, authority and URL encoding."""
    return unquote(re.sub("^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", path))
