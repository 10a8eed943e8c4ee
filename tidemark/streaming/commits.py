"""A stream of the commits of an open table, in the order of their versions.

The offset is the version of the last commit delivered, so a commit counts by its
number and not by the time of its file: files may be as old as they like. Versions
are delivered without a gap. Where one is missing below later ones, the stream waits
for it and says so once, by a row that names it.

The log directory is listed through Arrow's file systems (local, HDFS, S3, GCS), on
the driver; only names are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SOURCE_NAME = "tidemark_commits"

_COMMIT = re.compile(r"^(\d{20})\.json$")
_NONE = -1


def versions_in(path: str, above: int = _NONE) -> list[int]:
    """The versions of the commit files in a log directory, ascending."""
    from pyarrow import fs

    filesystem, folder = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
    names = (info.base_name for info in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
    found = (int(match[1]) for match in map(_COMMIT.match, names) if match)
    return sorted(version for version in found if version > above)


class _CommitReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, limit: int | None):
        self.path, self.limit = path, limit

    def initialOffset(self) -> dict:
        """Before the first commit there is: earlier ones may have been cleaned up."""
        return {"version": min(versions_in(self.path), default=0) - 1, "missing": _NONE}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        waiting = versions_in(self.path, start["version"])
        last = start["version"]
        for version in waiting[: self.limit]:
            if version != last + 1:
                break
            last = version
        hole = bool(waiting) and waiting[-1] > last and last + 1 not in waiting
        end = {"version": last, "missing": last + 1 if hole else _NONE}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [(version, None) for version in range(start["version"] + 1, end["version"] + 1)]
        if end["missing"] != _NONE and end["missing"] != start["missing"]:
            rows.append((None, end["missing"]))
        return iter(rows)


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> str:
        return "version bigint, missing bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        limit = self.options.get("maxCommitsPerTrigger")
        return _CommitReader(self.options["path"], int(limit) if limit else None)


def stream_versions(spark: SparkSession, log_path: str, limit: int | None = None) -> DataFrame:
    """Rows `version, missing`: a new commit each, or a version that is waited for."""
    spark.dataSource.register(CommitSource)
    reader = spark.readStream.format(SOURCE_NAME)
    if limit is not None:
        reader = reader.option("maxCommitsPerTrigger", limit)
    return reader.load(log_path)
