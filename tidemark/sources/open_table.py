"""Open tables (Delta layout): snapshots, change files and the commit log.

The commit log is read as an ordinary JSON table and resolved with an
aggregation, so tables can be read without a connector. Features that need
one (deletion vectors, column mapping, sidecar checkpoints) are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark import storage
from tidemark.operators import changes as C
from tidemark.sources.files import is_new
from tidemark.streaming.commits import stream_versions

LOG_DIR = "_delta_log"
CHANGE_DIR = "_change_data"

_ACTION = """
    add struct<path string, partitionValues map<string,string>, modificationTime bigint, dataChange boolean,
               deletionVector struct<storageType string>>,
    remove struct<path string, deletionTimestamp bigint, dataChange boolean>,
    cdc struct<path string, partitionValues map<string,string>>,
    metaData struct<schemaString string, partitionColumns array<string>, configuration map<string,string>>,
    protocol struct<minReaderVersion int, readerFeatures array<string>>,
    commitInfo struct<timestamp bigint>
"""

# Reader features that change which rows a data file holds.
_NEED_CONNECTOR = ("deletionVectors", "columnMapping", "v2Checkpoint")

_CHECKPOINT = re.compile(r"^(\d{20})\.checkpoint(\.\d{10}\.\d{10})?\.parquet$")
_COMMIT = re.compile(r"^(\d{20})\.json$")
_LAST_VERSION = 10**20 - 1


@dataclass(frozen=True)
class OpenTableSource:
    """An open table; the snapshot comes first, then the change feed.

    `first_read` says that the snapshot has been read already.
    """

    name: str
    path: str
    bookmark: datetime = C.EPOCH
    poll_interval_ms: int = 10_000
    on_fail: str = "stop"
    one_request: bool = False
    first_read: bool = False
    #: Commits of one trigger, at most; a run that reads what there is and ends takes all at once.
    max_files_per_trigger: int = 1_000


def has_connector(spark: SparkSession) -> bool:
    """True when the Delta connector is on the class path."""
    try:
        spark._jvm.java.lang.Class.forName(
            "io.delta.sql.DeltaSparkSessionExtension", False, spark._jvm.Thread.currentThread().getContextClassLoader()
        )
        return True
    except Exception:
        return False


def _version(name: Column) -> Column:
    return F.try_to_number(F.regexp_extract(name, r"(\d{20})\.json$", 1), F.lit("9" * 20)).cast("bigint")


def _log_path(path: str) -> str:
    return f"{path.rstrip('/')}/{LOG_DIR}"


def read_log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Actions of the log up to `version`, each with its commit version.

    Starts at the newest usable checkpoint and adds the later JSON commits. The
    log directory is read as one table; the range of commit names prunes files.
    """
    folder = _log_path(path)
    if not storage.exists(spark, folder):
        raise FileNotFoundError(f"no commit log in {path}")
    names = storage.list_names(spark, folder)
    if any(".checkpoint" in n and n.endswith((".parquet", ".json")) and not _CHECKPOINT.match(n) for n in names):
        raise ValueError("this log has checkpoints only a connector can read")
    top = _LAST_VERSION if version is None else version
    base = max((v for v in _whole_checkpoints(names) if v <= top), default=-1)
    _refuse_gaps([int(match[1]) for match in map(_COMMIT.match, names) if match and base < int(match[1]) <= top], base, version)
    commits = _commits_between(spark, path, base + 1, top)
    if base < 0:
        return commits
    files = [f"{folder}/{n}" for n in names if _CHECKPOINT.match(n) and int(n[:20]) == base]
    state = spark.read.schema(_ACTION).parquet(*files).withColumn("version", F.lit(base).cast("bigint"))
    return state.unionByName(commits)


def _whole_checkpoints(names: Sequence[str]) -> list[int]:
    """Versions of which every part of a checkpoint is there."""
    parts: dict[tuple[int, int], int] = {}
    for match in filter(None, map(_CHECKPOINT.match, names)):
        key = int(match[1]), int(match[2].split(".")[2]) if match[2] else 1
        parts[key] = parts.get(key, 0) + 1
    return [version for (version, wanted), there in parts.items() if there == wanted]


def _refuse_gaps(versions: Sequence[int], base: int, version: int | None) -> None:
    """Refuse a log that lacks a commit behind its checkpoint, or the version asked for."""
    top = max(versions, default=base)
    if len(versions) != top - base:
        raise ValueError(f"the log lacks commits between versions {base} and {top}")
    if version is not None and version != top:
        raise ValueError(f"the log ends at version {top}, there is no version {version}")
    if top < 0:
        raise FileNotFoundError("the log holds no commit")


def _commits_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Actions of the JSON commits of some versions, each with its version; the directory is one table, names prune files."""
    name = F.col("_metadata.file_name")
    commits = spark.read.schema(_ACTION).option("pathGlobFilter", "*.json").json(_log_path(path))
    commits = commits.where(name.between(f"{first:020d}.json", f"{last:020d}.json"))
    return commits.withColumn("version", _version(name)).where("version is not null")


def live_files(log: DataFrame) -> DataFrame:
    """The data files of the latest version in the log, as `path`.

    For each path its newest action decides; an add wins a tie.
    """
    # one number orders actions by version, adds last: it fits a hash aggregate
    is_add = F.col("add.path").isNotNull().cast("bigint")
    actions = log.select(
        F.coalesce("add.path", "remove.path").alias("path"), (F.col("version") * 2 + is_add).alias("rank")
    ).where("path is not null")
    newest = actions.groupBy("path").agg(F.max("rank").alias("rank"))
    return newest.where("rank % 2 = 1").select("path")


def _located(path: Column, table_path: str) -> Column:
    """A log path (URL-encoded, mostly relative) as a full file path."""
    plain = _decoded(path)
    full = F.concat(F.lit(table_path.rstrip("/") + "/"), plain)
    return F.when(plain.rlike("^([a-z][a-z0-9+.-]*:|/)"), plain).otherwise(full)


def table_schema(log: DataFrame, known: T.StructType | None = None) -> T.StructType:
    """The table's schema in the latest metadata of the log, or the one that is `known` if there is none."""
    head = log.agg(
        F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("meta"),
        F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("version"))).alias("protocol"),
        F.max(F.col("add.deletionVector").isNotNull()).alias("vectors"),
    ).first()
    features = set((head["protocol"]["readerFeatures"] if head["protocol"] else None) or [])
    mapping = ((head["meta"]["configuration"] if head["meta"] else None) or {}).get("delta.columnMapping.mode", "none")
    if head["vectors"] or features.intersection(_NEED_CONNECTOR) or mapping != "none":
        raise ValueError("this table uses features only a connector can read")
    if head["meta"] is None and known is not None:
        return known
    if head["meta"] is None:
        raise ValueError("the log holds no table metadata")
    return T.StructType.fromJson(json.loads(head["meta"]["schemaString"]))


def _file_key(path: Column) -> Column:
    """A path without scheme and authority, to compare paths from two places."""
    return F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _read_data(
    spark: SparkSession, table_path: str, files: DataFrame, schema: T.StructType, carried: Sequence[str] = (), below: str = "",
) -> DataFrame:
    """Rows of the listed parquet files (column `path`), in the table's schema.

    The directory `below` the table is read. The list is compared with its files once,
    by plain paths; the rows go by the path as the scan writes it, which is the same
    for all rows of a file, so no row has a path taken apart. A short list is a
    condition on that path, which leaves other files unopened; to a longer one, or one with
    columns to be `carried` to the rows, the rows are joined; Spark broadcasts it where it has
    measured it to be small. A path that is listed twice is read once, but its rows are there
    for each listing where columns are carried.
    """
    wanted = files.select(_file_key(_located(F.col("path"), table_path)).alias("_key"), *carried)
    root = f"{table_path.rstrip('/')}/{below}"
    wanted = storage.materialize(wanted if carried else wanted.distinct(), "wanted-files")
    if wanted.isEmpty():
        return spark.createDataFrame([], T.StructType([*schema.fields, *(wanted.schema[name] for name in carried)]))
    found = storage.materialize(_find(spark, root, wanted), "live-files")
    missing = found.where("_file is null").first()
    if missing is not None:
        raise FileNotFoundError(f"{missing['_key']} is in the log but not below {root}")
    rows = spark.read.option("basePath", table_path).schema(schema).parquet(root)
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    paths = found.select("_file").distinct()
    short = _is_small(paths)
    if short:
        rows = rows.where(F.col("_file").isin([row["_file"] for row in paths.collect()]))
    if carried:
        rows = rows.join(found.select("_file", *carried), "_file")
    elif not short:
        rows = rows.join(found, "_file", "left_semi")
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema], *carried)


#: Paths that are put as a condition on the scan, at most: they are literals on the driver.
PRUNED_PATHS = 10_000


def _is_small(table: DataFrame) -> bool:
    """Whether a written list of paths is short enough to be a condition, by its rows."""
    return table.count() <= PRUNED_PATHS


def _find(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """The wanted files, each with its `_file` as scans write it, null if it is not in the directory."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    present = listing.select(_file_key(F.col("path")).alias("_key"), F.col("_metadata.file_path").alias("_file"))
    return wanted.join(present, "_key", "left")


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a table at a version (the latest by default)."""
    if has_connector(spark):
        reader = spark.read.format("delta")
        return (reader.option("versionAsOf", version) if version is not None else reader).load(path)
    # the log is text: read once, then by column
    log = storage.materialize(read_log(spark, path, version), "log")
    return _read_data(spark, path, live_files(log), table_schema(log))


def read_snapshot_changes(spark: SparkSession, source: OpenTableSource, version: int | None = None) -> DataFrame:
    """The snapshot as change rows, stamped with the bookmark."""
    return C.as_inserts(read_snapshot(spark, source.path, version), source.bookmark)


def read_change_files(spark: SparkSession, path: str, bookmark: datetime = C.EPOCH) -> tuple[bool, DataFrame | None]:
    """New files of the change directory as normalised change rows.

    A missing directory means there is nothing to read yet.
    """
    directory = f"{path.rstrip('/')}/{CHANGE_DIR}"
    if not storage.list_names(spark, directory):
        return False, None
    rows = spark.read.parquet(directory).where(is_new(bookmark))
    return not rows.isEmpty(), C.normalise(rows, bookmark)


def read_changes(
    spark: SparkSession, path: str, versions: Sequence[int], bookmark: datetime = C.EPOCH, schema: T.StructType | None = None
) -> DataFrame:
    """Normalised change rows of some commits, in the table's `schema` (read from the whole log if not given).

    A commit with change files is read from them. One without was a plain
    append or removal of whole files: the rows of its data-changing adds are
    inserts, those of its removes deletes. Rows carry the commit's own time.
    """
    schema = schema or table_schema(read_log(spark, path, max(versions)))
    log = storage.materialize(read_commits(spark, path, versions), "commits")
    has_cdc = F.max(F.col("cdc").isNotNull()).alias("has_cdc")
    time = F.max(F.timestamp_millis("commitInfo.timestamp")).alias(C.COMMIT_TIME)
    commits = log.groupBy("version").agg(has_cdc, time)
    files = log.select(
        "version",
        F.coalesce("cdc.path", "add.path", "remove.path").alias("path"),
        F.when(F.col("cdc").isNotNull(), "cdc").when(F.col("add").isNotNull(), "insert")
        .when(F.col("remove").isNotNull(), "delete").alias("kind"),
        F.coalesce("add.dataChange", "remove.dataChange", F.lit(True)).alias("data_change"),
    ).where("kind is not null and data_change")
    files = files.join(commits, "version").where("(kind = 'cdc') = has_cdc")
    files = storage.materialize(files.drop("has_cdc", "data_change"), "change-files")

    def rows_of(kind: str, row_schema: T.StructType) -> DataFrame:
        part = files.where(F.col("kind") == kind).select("path", C.COMMIT_TIME)
        return _read_data(spark, path, part, row_schema, [C.COMMIT_TIME], CHANGE_DIR if kind == "cdc" else "")

    cdc_schema = T.StructType(schema.fields + [T.StructField(C.CHANGE_TYPE, T.StringType(), True)])
    order = [*schema.names, C.CHANGE_TYPE, C.COMMIT_TIME]
    plain = [
        rows_of(kind, schema).withColumn(C.CHANGE_TYPE, F.lit(kind)).select(order) for kind in ("insert", "delete")
    ]
    every = reduce(DataFrame.unionByName, plain, rows_of("cdc", cdc_schema).select(order))
    return C.normalise(every, bookmark)


def read_commits(spark: SparkSession, path: str, versions: Sequence[int]) -> DataFrame:
    """Actions of some JSON commits, each with its version."""
    first, last = min(versions), max(versions)
    commits = _commits_between(spark, path, first, last)
    return commits if len(set(versions)) > last - first else commits.where(F.col("version").isin(list(versions)))


def schema_after(spark: SparkSession, path: str, versions: Sequence[int], schema: T.StructType | None) -> T.StructType:
    """The table's schema after some commits, from the one before them: only these commits are read.

    Without one before, the whole log is.
    """
    if schema is None:
        return table_schema(read_log(spark, path, max(versions)))
    told = F.col("metaData").isNotNull() | F.col("protocol").isNotNull() | F.col("add.deletionVector").isNotNull()
    new = storage.materialize(read_commits(spark, path, versions).where(told), "commit-heads")
    return schema if new.isEmpty() else table_schema(new, schema)


def stream_commits(spark: SparkSession, source: OpenTableSource, all_at_once: bool = False) -> DataFrame:
    """The stream of new commits by version, whatever the times of their files."""
    return stream_versions(spark, _log_path(source.path), None if all_at_once else source.max_files_per_trigger)
