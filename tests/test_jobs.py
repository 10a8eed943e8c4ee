import json
import os
import pathlib
import time
from datetime import datetime, timezone

import pytest
from helpers import rows
from pyspark.sql import functions as F, types as T
from test_files import put, two_files
from test_open_table import SCHEMA as TABLE_SCHEMA, add, commit, data, head, remove, table  # noqa: F401

from tidemark import storage
from tidemark.sinks.files import FileSink, read_batches
from tidemark.sinks.open_table import OpenTableSink, read_table
from tidemark.sources import open_table as O
from tidemark.sources.files import FileSource
from tidemark.sources.open_table import OpenTableSource
from tidemark.streaming import jobs as J
from tidemark.streaming.commits import _CommitReader

SCHEMA = T.StructType().add("id", T.LongType()).add("value", T.StringType())


def test_quick_start(spark, folder):
    src, out, state = f"{folder}/csv", f"{folder}/json", f"{folder}/state"
    two_files(src)
    jobs = J.run(spark, [FileSource("csv_table", src)], [FileSink("json_table", "csv_table", out, "json")], state)
    assert jobs["csv_table"].reports == []
    assert rows(read_batches(spark, out, "json", SCHEMA)) == [(1, "red kite"), (2, "grey owl"), (3, "tern")]
    # again: nothing new, nothing written twice
    J.run(spark, [FileSource("csv_table", src)], [FileSink("json_table", "csv_table", out, "json")], state)
    assert read_batches(spark, out, "json", SCHEMA).count() == 3
    put(src, "test_3.csv", "id,value\n4,heron\n")
    J.run(spark, [FileSource("csv_table", src)], [FileSink("json_table", "csv_table", out, "json")], state)
    assert rows(read_batches(spark, out, "json", SCHEMA), "id") == [(1,), (2,), (3,), (4,)]
    # a second job with its own checkpoint adds to the table, it does not overwrite
    J.run(spark, [FileSource("csv_table", src)], [FileSink("json_table", "csv_table", out, "json")], f"{folder}/other")
    assert read_batches(spark, out, "json", SCHEMA).count() == 8


def test_two_sources_and_all_kinds_of_sinks(spark, folder):
    two_files(f"{folder}/csv")
    put(f"{folder}/js", "a.json", '{"id":9,"value":"x"}\n')
    sources = [FileSource("a", f"{folder}/csv"), FileSource("b", f"{folder}/js", "json")]
    sinks = [FileSink(kind, "a", f"{folder}/out_{kind}", kind) for kind in ("csv", "json", "avro", "parquet")]
    sinks += [OpenTableSink("open", "a", f"{folder}/open"), FileSink("other", "b", f"{folder}/other", "parquet")]
    jobs = J.run(spark, sources, sinks, f"{folder}/state")
    assert [job.reports for job in jobs.values()] == [[], []]
    expected = [(1, "red kite"), (2, "grey owl"), (3, "tern")]
    for sink in sinks[:4]:
        assert rows(read_batches(spark, sink.path, sink.filetype, SCHEMA)) == expected
    assert rows(read_table(spark, f"{folder}/open")) == expected
    assert rows(read_batches(spark, f"{folder}/other", "parquet", SCHEMA)) == [(9, "x")]


def test_bookmark_of_a_stream(spark, folder):
    two_files(f"{folder}/csv")
    for on_fail in ("stop", "skip"):
        source = FileSource("a", f"{folder}/csv", bookmark=datetime(2024, 1, 1, tzinfo=timezone.utc), on_fail=on_fail)
        J.run(spark, [source], [FileSink("o", "a", f"{folder}/{on_fail}", "json")], f"{folder}/state_{on_fail}")
        assert rows(read_batches(spark, f"{folder}/{on_fail}", "json", SCHEMA)) == [(3, "tern")]


def test_wiring_is_checked_first(spark, folder):
    source = FileSource("a", folder)
    with pytest.raises(ValueError, match="source names used twice"):
        J.start(spark, [source, source], [], folder)
    with pytest.raises(ValueError, match="unknown sources"):
        J.start(spark, [source], [FileSink("s", "b", folder)], folder)
    with pytest.raises(ValueError, match="on_fail"):
        J.start(spark, [FileSource("a", folder, on_fail="x")], [], folder)
    assert not os.listdir(folder)


def malformed(folder):
    put(folder, "1.csv", "id,value\n1,a\n", 1)
    put(folder, "2.csv", "id,value\nbad,b\n", 2)
    put(folder, "3.csv", "id,value\n3,c\n", 3)


def test_stop_ends_the_source_at_the_bad_file(spark, folder):
    malformed(f"{folder}/csv")
    source = FileSource("a", f"{folder}/csv", schema=SCHEMA, max_files_per_trigger=1)
    jobs = J.run(spark, [source], [FileSink("o", "a", f"{folder}/o", "json")], f"{folder}/state")
    assert rows(read_batches(spark, f"{folder}/o", "json", SCHEMA)) == [(1, "a")]
    assert [(r.table, r.action) for r in jobs["a"].reports] == [("a", "stop")] and jobs["a"].stopped == set()


def test_skip_leaves_only_the_bad_file_out(spark, folder):
    malformed(f"{folder}/csv")
    source = FileSource("a", f"{folder}/csv", schema=SCHEMA, on_fail="skip")
    jobs = J.run(spark, [source], [FileSink(k, "a", f"{folder}/{k}", k) for k in ("json", "parquet")], f"{folder}/state")
    for kind in ("json", "parquet"):
        assert rows(read_batches(spark, f"{folder}/{kind}", kind, SCHEMA)) == [(1, "a"), (3, "c")]
    assert [r.action for r in jobs["a"].reports] == ["skip"] and "2.csv" in jobs["a"].reports[0].detail
    assert "2.csv" in storage.read_text(spark, f"{folder}/state/a/rejected/0.json")
    put(f"{folder}/csv", "4.csv", "id,value\n4,d\n")
    J.run(spark, [source], [FileSink("json", "a", f"{folder}/json", "json")], f"{folder}/state")
    assert rows(read_batches(spark, f"{folder}/json", "json", SCHEMA), "id") == [(1,), (3,), (4,)]


def test_skip_an_unreadable_parquet_file(spark, folder):
    spark.createDataFrame([(1, "a")], SCHEMA).coalesce(1).write.parquet(f"{folder}/pq")
    pathlib.Path(folder, "pq", "bad.parquet").write_text("this is no parquet")
    source = FileSource("a", f"{folder}/pq", "parquet", schema=SCHEMA, on_fail="skip")
    jobs = J.run(spark, [source], [FileSink("o", "a", f"{folder}/o", "json")], f"{folder}/state")
    assert rows(read_batches(spark, f"{folder}/o", "json", SCHEMA)) == [(1, "a")]
    assert "bad.parquet" in jobs["a"].reports[0].detail


def test_a_directory_that_is_empty_at_first(spark, folder):
    os.makedirs(f"{folder}/csv")
    source, sink = FileSource("a", f"{folder}/csv"), FileSink("o", "a", f"{folder}/o", "json")
    assert J.run(spark, [source], [sink], f"{folder}/state")["a"].reports == []
    assert not os.path.exists(f"{folder}/o")


class FailingSink(FileSink):
    """Refuses batches from number 1 on."""

    def write(self, df, job, batch_id):
        if batch_id >= 1:
            raise RuntimeError("no space")
        super().write(df, job, batch_id)


@pytest.mark.parametrize("on_fail, stopped", [("stop", {"bad"}), ("skip", set())])
def test_a_failing_sink_leaves_the_others_running(spark, folder, on_fail, stopped):
    for n in (1, 2, 3):
        put(f"{folder}/csv", f"{n}.csv", f"id,value\n{n},x\n", n)
    source = FileSource("a", f"{folder}/csv", max_files_per_trigger=1)
    sinks = [FailingSink("bad", "a", f"{folder}/bad", "json", on_fail), FileSink("good", "a", f"{folder}/good", "json")]
    jobs = J.run(spark, [source], sinks, f"{folder}/state")
    assert rows(read_batches(spark, f"{folder}/good", "json", SCHEMA), "id") == [(1,), (2,), (3,)]
    assert rows(read_batches(spark, f"{folder}/bad", "json", SCHEMA), "id") == [(1,)]
    assert jobs["a"].stopped == stopped
    assert len(jobs["a"].reports) == (1 if on_fail == "stop" else 2)


class Full(FileSink):
    """Fails while the file `full` exists beside its folder."""

    def write(self, df, job, batch_id):
        if batch_id >= 1 and os.path.exists(f"{self.path}.full"):
            raise RuntimeError("no space")
        super().write(df, job, batch_id)


@pytest.mark.parametrize("isolate", [False, True])
def test_a_stopped_destination_resumes_without_loss(spark, folder, isolate):
    for n in (1, 2, 3):
        put(f"{folder}/csv", f"{n}.csv", f"id,value\n{n},x\n", n)
    pathlib.Path(folder, "a.full").touch()
    source = FileSource("s", f"{folder}/csv", max_files_per_trigger=1)
    sinks = [Full("a", "s", f"{folder}/a", "json")] + ([FileSink("b", "s", f"{folder}/b", "json")] if isolate else [])
    jobs = J.run(spark, [source], sinks, f"{folder}/state", isolate=isolate)
    assert rows(read_batches(spark, f"{folder}/a", "json", SCHEMA), "id") == [(1,)]
    assert [r.action for r in jobs["s/a" if isolate else "s"].reports] == ["stop", "stop"]
    pathlib.Path(folder, "a.full").unlink()
    J.run(spark, [source], sinks, f"{folder}/state", isolate=isolate)
    for sink in sinks:
        assert rows(read_batches(spark, sink.path, "json", SCHEMA), "id") == [(1,), (2,), (3,)]


def test_a_failed_source_leaves_other_sources_running(spark, folder):
    malformed(f"{folder}/bad")
    two_files(f"{folder}/good")
    sources = [FileSource("bad", f"{folder}/bad", schema=SCHEMA), FileSource("good", f"{folder}/good")]
    sinks = [FileSink(f"to_{s.name}", s.name, f"{folder}/o_{s.name}", "json") for s in sources]
    jobs = J.run(spark, sources, sinks, f"{folder}/state")
    assert [r.action for r in jobs["bad"].reports] == ["stop"] and jobs["good"].reports == []
    assert read_batches(spark, f"{folder}/o_good", "json", SCHEMA).count() == 3


def test_polling_picks_up_new_files(spark, folder):
    two_files(f"{folder}/csv")
    source = FileSource("a", f"{folder}/csv", poll_interval_ms=200)
    jobs = J.start(spark, [source], [FileSink("o", "a", f"{folder}/o", "json")], f"{folder}/state")
    query = jobs["a"].query
    try:
        query.processAllAvailable()
        put(f"{folder}/csv", "late.csv", "id,value\n4,late\n")
        time.sleep(0.5)
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(read_batches(spark, f"{folder}/o", "json", SCHEMA), "id") == [(1,), (2,), (3,), (4,)]


CHANGES = (
    T.StructType().add("id", T.IntegerType()).add("name", T.StringType())
    .add("_change_type", T.StringType()).add("_commit_timestamp", T.TimestampType())
)


def test_open_table_snapshot_then_changes(spark, table):  # noqa: F811
    source, out = OpenTableSource("t", table), f"{table}-out"
    sinks = [FileSink("csv", "t", out, "csv"), OpenTableSink("open", "t", f"{table}-open")]
    J.run(spark, [source], sinks, f"{table}-state")
    assert rows(read_batches(spark, out, "csv", CHANGES), "id", "name", "_change_type") == [(7, "Oak", "insert")]
    commit(table, 6, {"commitInfo": {"timestamp": 1_700_000_009_000}}, add(data(spark, table, "f.parquet", [(8, "Pine")])))
    commit(table, 7, {"commitInfo": {"timestamp": 1_700_000_010_000}}, remove("e.parquet"))
    for _ in range(2):
        J.run(spark, [source], sinks, f"{table}-state")
    expected = [(7, "Oak", "delete", 1_700_000_010), (7, "Oak", "insert", 0), (8, "Pine", "insert", 1_700_000_009)]
    for got in (read_batches(spark, out, "csv", CHANGES), read_table(spark, f"{table}-open")):
        assert rows(got.withColumn("_commit_timestamp", F.unix_seconds("_commit_timestamp"))) == expected


def test_first_read_skips_the_snapshot(spark, table):  # noqa: F811
    source = OpenTableSource("t", table, first_read=True, bookmark=datetime.fromtimestamp(1_700_000_001.5, timezone.utc))
    J.run(spark, [source], [FileSink("o", "t", f"{table}-out", "json")], f"{table}-state")
    got = read_batches(spark, f"{table}-out", "json", CHANGES)
    assert rows(got, "id", "name", "_change_type") == [(0, "Elm", "delete"), (7, "Oak", "insert")]


def test_a_broken_log_follows_the_policy(spark, folder):
    for on_fail in ("stop", "skip"):
        path = f"{folder}/{on_fail}"
        commit(path, 0, *head(), add("missing.parquet"))
        jobs = J.run(spark, [OpenTableSource("t", path, on_fail=on_fail)], [FileSink("o", "t", f"{path}-o", "json")], f"{path}-s")
        assert [r.action for r in jobs["t"].reports] == [on_fail]


def test_an_old_file_that_arrives_late_is_read(spark, folder):
    put(f"{folder}/csv", "new.csv", "id,value\n1,a\n")
    source = FileSource("a", f"{folder}/csv", schema=SCHEMA)
    sink = FileSink("o", "a", f"{folder}/o", "json")
    J.run(spark, [source], [sink], f"{folder}/s")
    path = put(f"{folder}/csv", "old.csv", "id,value\n2,b\n")
    month_ago = time.time() - 30 * 86_400
    os.utime(path, (month_ago, month_ago))
    J.run(spark, [source], [sink], f"{folder}/s")
    assert rows(read_batches(spark, f"{folder}/o", "json", SCHEMA)) == [(1, "a"), (2, "b")]


def test_later_files_bring_columns(spark, folder):
    for k in range(9):
        put(f"{folder}/in", f"{k}.json", json.dumps({"id": k} if k < 8 else {"id": k, "value": "late"}) + "\n")
    source, sink = FileSource("a", f"{folder}/in", "json"), FileSink("o", "a", f"{folder}/o", "json")
    J.run(spark, [source], [sink], f"{folder}/s")
    put(f"{folder}/in", "9.json", '{"id":9,"more":true}\n')
    jobs = J.run(spark, [source], [sink], f"{folder}/s")
    assert jobs["a"].reports == []
    wide = T.StructType([*SCHEMA.fields, T.StructField("more", T.BooleanType())])
    got = rows(read_batches(spark, f"{folder}/o", "json", wide))
    assert got == [*((k, None, None) for k in range(8)), (8, "late", None), (9, None, True)]
    assert jobs["a"].known_schema(spark).names == ["id", "value", "more"]


def test_a_csv_file_of_other_columns_fails(spark, folder):
    two_files(f"{folder}/csv")
    put(f"{folder}/csv", "z.csv", "other\n1\n")
    jobs = J.run(spark, [FileSource("a", f"{folder}/csv")], [FileSink("o", "a", f"{folder}/o", "json")], f"{folder}/s")
    assert [report.action for report in jobs["a"].reports] == ["stop"]


@pytest.mark.parametrize("on_fail", ["stop", "skip"])
def test_a_snapshot_that_fails_is_taken_later(spark, table, folder, on_fail):  # noqa: F811
    source, sink = OpenTableSource("t", table, on_fail=on_fail), FileSink("o", "t", f"{folder}/o-{on_fail}", "json")
    lost = pathlib.Path(table, "e.parquet")
    kept = lost.read_bytes()
    lost.unlink()
    jobs = J.run(spark, [source], [sink], f"{folder}/s")
    assert len(jobs["t"].reports) == 1
    lost.write_bytes(kept)
    for _ in range(2):
        assert J.run(spark, [source], [sink], f"{folder}/s")["t"].reports == []
        got = read_batches(spark, sink.path, "json", T.StructType().add("id", T.LongType()).add("_change_type", T.StringType()))
        assert rows(got) == [(7, "insert")]


def test_commits_count_by_version_not_by_time(spark, folder):
    """Old-dated commits arrive once and in order; a missing one is reported and waited for."""
    now, out, state = time.time(), f"{folder}-out", f"{folder}-state"

    def put(version, *actions):
        commit(folder, version, *actions)
        os.utime(f"{folder}/_delta_log/{version:020d}.json", (now - 86400 * 30 * version,) * 2)

    def added(version):
        return {"commitInfo": {"timestamp": 1_700_000_000_000 + version}}, add(data(spark, folder, f"{version}.parquet", [(version, "x")]))

    source, sink = OpenTableSource("t", folder), FileSink("o", "t", out, "json")
    got = lambda: sorted(row["id"] for row in spark.read.json(f"{out}/batch=*").collect())
    put(0, *head(), added(0)[1])
    assert not J.run(spark, [source], [sink], state)["t"].reports
    put(1, *added(1))
    put(3, *added(3))
    put(200, *added(200))
    reports = J.run(spark, [source], [sink], state)["t"].reports
    assert [(r.action, r.detail) for r in reports] == [("wait", "commit 2 is missing, later ones wait for it")]
    assert got() == [0, 1]
    assert not J.run(spark, [source], [sink], state)["t"].reports
    put(2, *added(2))
    reports = J.run(spark, [source], [sink], state)["t"].reports
    assert [r.detail[:8] for r in reports] == ["commit 4"] and got() == [0, 1, 2, 3]


def test_commits_of_a_trigger_are_bounded(folder):
    log = pathlib.Path(folder, "_delta_log")
    log.mkdir()
    for version in (5, 6, 7, 9):
        (log / f"{version:020d}.json").write_text("{}")
    reader = _CommitReader(str(log), 2)
    start = reader.initialOffset()
    rows, end = reader.read(start)
    assert list(rows) == [(5, None), (6, None)] and end == {"version": 6, "missing": -1}
    rows, end = reader.read(end)
    assert list(rows) == [(7, None), (None, 8)] and end == {"version": 7, "missing": 8}
    assert reader.read(end)[1] == end and list(reader.readBetweenOffsets(start, end)) == [(5, None), (6, None), (7, None), (None, 8)]


def test_new_commits_tell_the_schema(spark, folder):
    """Batches behind the first read the new commits only, also where one changes the schema."""
    wider = json.loads(TABLE_SCHEMA)
    wider["fields"].append({"name": "more", "type": "integer", "nullable": True, "metadata": {}})
    stamp = {"commitInfo": {"timestamp": 1_700_000_000_000}}
    commit(folder, 0, *head(), add(data(spark, folder, "a.parquet", [(1, "a")])))
    schema = O.schema_after(spark, folder, [0], None)
    commit(folder, 1, stamp, add(data(spark, folder, "b.parquet", [(2, "b")])))
    assert O.schema_after(spark, folder, [1], schema) == schema
    commit(folder, 2, *head(json.dumps(wider)))
    assert O.schema_after(spark, folder, [1, 2], schema).names == ["id", "name", "more"]
    assert rows(O.read_changes(spark, folder, [1], schema=schema), "id") == [(2,)]
