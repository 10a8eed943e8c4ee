"""Run sources into destinations: one streaming query per source.

Every micro-batch of a source goes to each of its destinations. Progress moves
only after the batch is written, a replayed batch replaces what it wrote before,
and a destination that stops leaves the others running.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark import storage
from tidemark.operators.schemas import SchemaConflict, merge_schemas
from tidemark.sinks.files import FileSink
from tidemark.sinks.open_table import OpenTableSink
from tidemark.sources import files as file_source, open_table, responses
from tidemark.sources.files import FileSource
from tidemark.sources.open_table import OpenTableSource
from tidemark.sources.responses import ApiSource
from tidemark.streaming.ticks import stream_polls

log = logging.getLogger("tidemark")

Source = FileSource | OpenTableSource | ApiSource
Sink = FileSink | OpenTableSink


class SourceFailed(RuntimeError):
    """The rows of a batch could not be read."""


class AllStopped(RuntimeError):
    """No destination is left to write to; the batch stays unread for a restart."""


@dataclass
class Report:
    """Something a failure policy left out."""

    table: str
    batch_id: int
    action: str
    detail: str


@dataclass
class TableJob:
    """One source with its destinations, and what happened so far."""

    source: Source
    sinks: Sequence[Sink]
    folder: str
    job: str
    cache: bool = False
    schema: T.StructType | None = None
    stopped: set[str] = field(default_factory=set)
    reports: list[Report] = field(default_factory=list)
    query: StreamingQuery | None = None

    def report(self, table: str, batch_id: int, action: str, detail: object) -> None:
        log.warning("%s batch %s: %s (%s)", table, batch_id, action, detail)
        self.reports.append(Report(table, batch_id, action, str(detail)))

    def deliver(self, rows: DataFrame, batch_id: int) -> None:
        """Write one batch to every running destination, all at the same time.

        Destinations read the source's files each for themselves, which has
        proved cheaper than keeping the rows; `cache` keeps them for the batch.
        """
        running = [sink for sink in self.sinks if sink.name not in self.stopped]
        keep = self.cache and len(running) > 1
        if keep:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if _read_or_fail(rows.isEmpty):
                return
            known = self.known_schema(rows.sparkSession)
            merged = _read_or_fail(lambda: merge_schemas(known, rows.schema))
            failures = self._write_all(running, rows, batch_id)
            if failures:
                # is it the destination that failed, or the rows?
                _read_or_fail(lambda: rows.write.format("noop").mode("overwrite").save())
            for sink, problem in failures:
                self.report(sink.name, batch_id, sink.on_fail, problem)
                if sink.on_fail == "stop":
                    self.stopped.add(sink.name)
            if self.sinks and len(self.stopped) == len(self.sinks):
                raise AllStopped(f"every destination of {self.source.name} has stopped")
            self._keep_schema(rows.sparkSession, merged)
        finally:
            if keep:
                rows.unpersist()

    def known_schema(self, spark: SparkSession) -> T.StructType | None:
        """All columns the source has had so far, also before a restart."""
        if self.schema is None:
            text = storage.read_text(spark, f"{self.folder}/merged_schema.json")
            self.schema = None if text is None else T.StructType.fromJson(json.loads(text))
        return self.schema

    def _keep_schema(self, spark: SparkSession, merged: T.StructType) -> None:
        if merged != self.schema:
            storage.write_text(spark, f"{self.folder}/merged_schema.json", merged.json())
        self.schema = merged

    def _write_all(self, running: Sequence[Sink], rows: DataFrame, batch_id: int) -> list[tuple[Sink, Exception]]:
        def write(sink: Sink) -> Exception | None:
            try:
                sink.write(rows, self.job, batch_id)
            except Exception as problem:
                return problem
            return None

        if len(running) == 1:
            outcomes = [write(running[0])]
        else:
            with ThreadPoolExecutor(max(1, len(running))) as pool:
                outcomes = list(pool.map(inheritable_thread_target(rows.sparkSession)(write), running))
        return [(sink, problem) for sink, problem in zip(running, outcomes) if problem is not None]


def _read_or_fail(action: Callable):
    try:
        return action()
    except Exception as problem:
        raise SourceFailed(str(problem)) from problem


# What one micro-batch of each kind of source does ----------------------------

def _deliver_rows(job: TableJob) -> Callable[[DataFrame, int], None]:
    return job.deliver


def _deliver_named_files(job: TableJob) -> Callable[[DataFrame, int], None]:
    """Read the files named in the batch, leaving unreadable ones out."""
    source = job.source

    def write(names: DataFrame, batch_id: int) -> None:
        spark = names.sparkSession
        paths = sorted(row["path"] for row in names.collect())
        if not paths:
            return
        try:
            job.deliver(_named_files(spark, source, paths, job.known_schema(spark)), batch_id)
            return
        except SourceFailed as problem:
            if source.on_fail == "stop":
                raise
            schema = source.schema or _readable_schema(spark, paths, source, job.known_schema(spark))
            if schema is None:
                readable, unreadable = [], paths
            else:
                readable, unreadable = file_source.split_unreadable(spark, paths, source, schema)
            job.report(source.name, batch_id, "skip", unreadable or problem)
            storage.make_dir(spark, f"{job.folder}/rejected")
            storage.write_text(spark, f"{job.folder}/rejected/{batch_id}.json", json.dumps(unreadable or paths))
        if readable and unreadable:
            job.deliver(_named_files(spark, source, readable, job.known_schema(spark)), batch_id)

    return write


def _named_files(spark: SparkSession, source: FileSource, paths: list[str], known: T.StructType | None) -> DataFrame:
    """The files as one table. Without a given schema all of them decide: columns that are known keep their type."""

    def read() -> DataFrame:
        schema = source.schema
        if schema is None:
            schema = file_source.infer_schema(spark, paths, source.filetype, source.read_options())
            if known is not None:
                schema = T.StructType([known[f.name] if f.name in known.names else f for f in schema])
        return file_source.read_files(spark, paths, source.filetype, schema, source.read_options())

    return _read_or_fail(read)


def _readable_schema(
    spark: SparkSession, paths: list[str], source: FileSource, known: T.StructType | None
) -> T.StructType | None:
    """The merged schema of the files that can be read, where one of the batch can't."""
    merged = known
    for path in paths:
        try:
            merged = merge_schemas(merged, _named_files(spark, source, [path], merged).schema)
        except (SourceFailed, SchemaConflict):
            continue
    return merged


def _deliver_commits(job: TableJob) -> Callable[[DataFrame, int], None]:
    """The table's snapshot first, then the changes of each new commit.

    A marker with the snapshot's version and batch is written once the snapshot is
    delivered; until then every batch is a snapshot. One that could not be read is
    taken up by the next batch or, as `_restart_without_snapshot` has it, the next start.
    """
    source = job.source
    marker = f"{job.folder}/snapshot_version"
    schema_file = f"{job.folder}/table_schema.json"

    def snapshot(commits: DataFrame, batch_id: int) -> bool:
        """Deliver the snapshot if this batch is the one for it."""
        spark = commits.sparkSession
        text = storage.read_text(spark, marker)
        version, batch = (int(n) for n in text.split()) if text else (None, batch_id)
        if source.first_read or batch != batch_id:
            return False
        if version is None:
            version = commits.agg(F.max("version")).first()[0]
        if version is None:
            return True
        job.deliver(_read_or_fail(lambda: open_table.read_snapshot_changes(spark, source, version)), batch_id)
        storage.write_text(spark, marker, f"{version} {batch_id}")
        return True

    def rows_of(commits: DataFrame, batch_id: int) -> DataFrame | None:
        spark = commits.sparkSession
        text = storage.read_text(spark, marker)
        done = int(text.split()[0]) if text else -1
        ends = commits.where(F.col("version") > done).agg(F.min("version"), F.max("version")).first()
        if ends[0] is None:
            return None
        versions = range(ends[0], ends[1] + 1)
        text = storage.read_text(spark, schema_file)
        schema = open_table.schema_after(spark, source.path, versions, None if text is None else T.StructType.fromJson(json.loads(text)))
        if text != schema.json():
            storage.write_text(spark, schema_file, schema.json())
        rows = open_table.read_changes(spark, source.path, versions, source.bookmark, schema)
        if source.first_read and source.bookmark > open_table.C.EPOCH:
            rows = open_table.C.newer_than(rows, open_table.C.COMMIT_TIME, source.bookmark)
        return rows

    def write(commits: DataFrame, batch_id: int) -> None:
        commits = commits.persist(StorageLevel.MEMORY_AND_DISK)
        hole = commits.where("missing is not null").first()
        if hole is not None:
            job.report(source.name, batch_id, "wait", f"commit {hole['missing']} is missing, later ones wait for it")
        try:
            if snapshot(commits, batch_id):
                return
            rows = _read_or_fail(lambda: rows_of(commits, batch_id))
            if rows is not None:
                job.deliver(rows, batch_id)
        except SourceFailed as problem:
            if source.on_fail == "stop":
                raise
            job.report(source.name, batch_id, "skip", problem)
        finally:
            commits.unpersist()

    return write


def _restart_without_snapshot(spark: SparkSession, job: TableJob) -> None:
    """Begin a stream of commits again if it has delivered no snapshot, and so nothing at all."""
    undelivered = not job.source.first_read and not storage.exists(spark, f"{job.folder}/snapshot_version")
    if undelivered and storage.exists(spark, f"{job.folder}/stream"):
        storage.delete(spark, f"{job.folder}/stream")


# Polls whose state is kept, for replays.
KEPT_POLLS = 10


def _deliver_polls(job: TableJob) -> Callable[[DataFrame, int], None]:
    """Poll the endpoints, each since its last poll that succeeded.

    Every poll notes the endpoints' bookmarks and cursors under its batch
    number and goes by the newest note of an earlier batch, so a replayed poll
    asks for the same data again.
    """
    source = job.source
    schema_file = f"{job.folder}/schema.json"
    notes = f"{job.folder}/polls"

    def frozen_schema(spark: SparkSession, landed: DataFrame) -> T.StructType:
        if source.schema is not None:
            return source.schema
        text = storage.read_text(spark, schema_file)
        if text is not None:
            return T.StructType.fromJson(json.loads(text))
        schema = responses.first_schema(landed, source.select_field, source.name)
        if schema.fields:
            storage.write_text(spark, schema_file, schema.json())
        return schema

    def poll(spark: SparkSession, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        landed = responses.poll(spark, source, state)
        return landed, responses.rows_of(landed, source, frozen_schema(spark, landed))

    def write(tick: DataFrame, batch_id: int) -> None:
        spark = tick.sparkSession
        now = tick.first()
        if now is None:
            return
        done = [n for n in _numbers(spark, notes) if n < batch_id]
        state = spark.read.parquet(f"{notes}/{max(done)}") if done else None
        try:
            landed, rows = _read_or_fail(lambda: poll(spark, state))
            if rows.columns:
                job.deliver(rows, batch_id)
        except SourceFailed as problem:
            if source.on_fail == "stop":
                raise
            job.report(source.name, batch_id, "skip", problem)
            return
        responses.next_state(landed, source, now["time"], state).write.mode("overwrite").parquet(f"{notes}/{batch_id}")
        note = spark.read.parquet(f"{notes}/{batch_id}")
        left_out = note.where("not polled").count()
        if left_out:
            job.report(source.name, batch_id, "skip", f"{left_out} endpoints refused")
        unfinished = note.where("unfinished")
        first = unfinished.agg(F.min("endpoint").alias("endpoint"), F.count(F.lit(1)).alias("n")).first()
        if first["n"] and source.pagination != "cursor":
            more = f" and {first['n'] - 1} more" if first["n"] > 1 else ""
            detail = f"{first['endpoint']}{more} stopped at the request limit; the next poll goes on there"
            job.report(source.name, batch_id, "resume", detail)
        for old in sorted(done)[:-KEPT_POLLS]:
            storage.delete(spark, f"{notes}/{old}")

    return write


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return [int(name) for name in storage.list_names(spark, folder) if name.isdigit()]


def _tidy(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """`write`, leaving none of its intermediate tables behind."""

    def write_and_delete(batch: DataFrame, batch_id: int) -> None:
        with storage.temporary(batch.sparkSession):
            write(batch, batch_id)

    return write_and_delete


def _stream_of(spark: SparkSession, job: TableJob, once: bool) -> tuple[DataFrame, Callable[[DataFrame, int], None]]:
    source = job.source
    if isinstance(source, ApiSource):
        return stream_polls(spark), _deliver_polls(job)
    if isinstance(source, OpenTableSource):
        _restart_without_snapshot(spark, job)
        return open_table.stream_commits(spark, source, once or source.one_request), _deliver_commits(job)
    if source.on_fail == "skip" or source.schema is None:
        return file_source.stream_file_names(spark, source), _deliver_named_files(job)
    return file_source.stream_files(spark, source), _deliver_rows(job)


# Starting --------------------------------------------------------------------

def check(sources: Sequence[Source], sinks: Sequence[Sink]) -> None:
    """Refuse duplicate names and destinations of unknown sources."""
    for kind, names in (("source", [s.name for s in sources]), ("destination", [s.name for s in sinks])):
        twice = sorted(name for name, count in Counter(names).items() if count > 1)
        if twice:
            raise ValueError(f"{kind} names used twice: {twice}")
    unknown = sorted({sink.source for sink in sinks} - {source.name for source in sources})
    if unknown:
        raise ValueError(f"destinations name unknown sources: {unknown}")
    for table in [*sources, *sinks]:
        if table.on_fail not in ("stop", "skip"):
            raise ValueError(f"on_fail of {table.name} must be stop or skip")


def _job_id(spark: SparkSession, folder: str) -> str:
    """An id that stays with the checkpoint folder."""
    known = storage.read_text(spark, f"{folder}/job_id")
    if known is None:
        known = "job" + uuid.uuid4().hex[:12]
        storage.make_dir(spark, folder)
        storage.write_text(spark, f"{folder}/job_id", known)
    return known


def start(
    spark: SparkSession,
    sources: Sequence[Source],
    sinks: Sequence[Sink],
    checkpoint: str,
    once: bool = False,
    cache: bool = False,
    isolate: bool = False,
) -> dict[str, TableJob]:
    """Start one query per source and return the jobs by source name.

    With `isolate` every destination gets a query and a checkpoint of its own
    (jobs are then named `source/destination`): a destination that stops
    resumes after a restart where it left off, at the price of one more read of
    the source, which API sources would make as further requests.

    `once` (or `one_request` of a source) reads what there is now and ends.
    `cache` keeps each batch for its destinations instead of re-reading it.
    """
    check(sources, sinks)
    jobs = {}
    for source in sources:
        fed = [sink for sink in sinks if sink.source == source.name]
        parts = {f"{source.name}/{sink.name}": [sink] for sink in fed} if isolate and fed else {source.name: fed}
        for name, part in parts.items():
            folder = f"{checkpoint.rstrip('/')}/{name}"
            jobs[name] = TableJob(source, part, folder, _job_id(spark, folder), cache)
    streams = {name: _stream_of(spark, job, once) for name, job in jobs.items()}
    for name, job in jobs.items():
        stream, write = streams[name]
        writer = stream.writeStream.queryName(f"{name}-{job.job}").foreachBatch(_tidy(write))
        writer = writer.option("checkpointLocation", f"{job.folder}/stream")
        if once or job.source.one_request:
            writer = writer.trigger(availableNow=True)
        else:
            writer = writer.trigger(processingTime=f"{job.source.poll_interval_ms} milliseconds")
        job.query = writer.start()
    return jobs


def run(
    spark: SparkSession,
    sources: Sequence[Source],
    sinks: Sequence[Sink],
    checkpoint: str,
    cache: bool = False,
    isolate: bool = False,
) -> dict[str, TableJob]:
    """Read everything there is now, once, and wait; failed sources are reported."""
    jobs = start(spark, sources, sinks, checkpoint, once=True, cache=cache, isolate=isolate)
    for name, job in jobs.items():
        try:
            job.query.awaitTermination()
        except Exception as problem:
            job.report(name, job.query.lastProgress["batchId"] + 1 if job.query.lastProgress else 0, "stop", problem)
    return jobs
