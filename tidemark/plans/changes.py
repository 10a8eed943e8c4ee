"""Change feeds, snapshots, commit logs, schema union and type conformance."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import storage
from tidemark.functions.types import conform
from tidemark.operators import changes as C
from tidemark.operators.schemas import union_batches
from tidemark.plans import load
from tidemark.plans.copies import newest_file_time
from tidemark.sources import open_table as O
from tidemark.sinks.files import FileSink, read_batches
from tidemark.sources.open_table import OpenTableSource
from tidemark.streaming.jobs import run

_STAMP = datetime(2024, 2, 3, 4, 5, 6, tzinfo=timezone.utc)


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn(C.COMMIT_TIME, F.col(C.COMMIT_TIME).cast("timestamp_ntz"))


def _change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a change feed: finished ones inserted, open ones updated, pending ones deleted."""
    kinds = (
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("insert")))
        .when(F.col("o_orderstatus") == "O", F.array(F.lit("update_preimage"), F.lit("update_postimage")))
        .otherwise(F.array(F.lit("delete")))
    )
    return load(spark, sf_dir, "orders").withColumn(C.CHANGE_TYPE, F.explode(kinds))


def change_feed_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(C.normalise(_change_rows(spark, sf_dir), _STAMP))


def change_feed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change files written in two lots; a bookmark leaves the first one out."""
    table = storage.scratch_dir(spark, "orders-table")
    folder = f"{table}/{O.CHANGE_DIR}"
    rows = _change_rows(spark, sf_dir)
    rows.where("year(o_orderdate) <= 1997").write.parquet(folder)
    bookmark = newest_file_time(spark, folder)
    rows.where("year(o_orderdate) > 1997").write.mode("append").parquet(folder)
    _, changes = O.read_change_files(spark, table, bookmark)
    stamped = F.col(C.COMMIT_TIME) == C.bookmark_literal(bookmark)
    return changes.withColumn("stamped", stamped).drop(C.COMMIT_TIME)


def snapshot_as_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(C.as_inserts(load(spark, sf_dir, "customer"), _STAMP))


def _stage_log_table(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Lineitem as a partitioned open table, all its commits written."""
    table, lines, commits = _lineitem_table(spark, sf_dir)
    for version, actions in enumerate(commits):
        _commit(spark, table, version, actions)
    return table, lines


def _lineitem_table(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, list[list[dict]]]:
    """Lineitem as the files of a partitioned open table, with four commits to come.

    1 adds every file, 2 removes the returned lines, 3 rewrites the accepted
    ones without changing rows, 4 adds the returned lines back that were open.
    """
    lines = load(spark, sf_dir, "lineitem")
    table = storage.scratch_dir(spark, "lineitem-table")
    keys = ["l_returnflag", "l_linestatus"]
    lines.write.partitionBy(*keys).parquet(table)
    lines.where("l_returnflag = 'A'").write.mode("append").partitionBy(*keys).parquet(table)
    files: dict[str, list[str]] = {}
    for flag in (n for n in storage.list_names(spark, table) if "=" in n):
        for status in storage.list_names(spark, f"{table}/{flag}"):
            group = f"{flag}/{status}"
            files[group] = [f"{group}/{n}" for n in storage.list_names(spark, f"{table}/{group}") if n.endswith(".parquet")]
    copies = _second_copies(spark, table, files)
    accepted = [f for group in files if "flag=A" in group for f in files[group] if f not in copies]
    returned = [f for group in files if "flag=R" in group for f in files[group]]
    first = [f for group in files.values() for f in group if f not in copies]
    meta = {"schemaString": lines.schema.json(), "partitionColumns": keys, "configuration": {}}
    return table, lines, [
        [{"protocol": {"minReaderVersion": 1}}, {"metaData": meta}],
        [_add(f, True) for f in first],
        [_remove(f, True) for f in returned],
        [_remove(f, False) for f in accepted] + [_add(f, False) for f in sorted(copies)],
        [_add(f, True) for f in returned if "status=O" in f],
    ]


def _second_copies(spark: SparkSession, table: str, files: dict[str, list[str]]) -> set[str]:
    """Of the accepted lines, written twice, the files of the later write."""
    job = {f: f.rsplit("/", 1)[1].split("-", 2)[2][:36] for group in files.values() for f in group}
    first_jobs = {job[f] for group in files if "flag=A" not in group for f in files[group]}
    return {f for group in files.values() for f in group if job[f] not in first_jobs}


def _add(path: str, change: bool) -> dict:
    values = dict(part.split("=") for part in path.split("/")[:-1])
    return {"add": {"path": path, "partitionValues": values, "dataChange": change}}


def _remove(path: str, change: bool) -> dict:
    return {"remove": {"path": path, "dataChange": change}}


def _commit(spark: SparkSession, table: str, version: int, actions: list[dict]) -> None:
    info = {"commitInfo": {"timestamp": 1_700_000_000_000 + version * 1000}}
    storage.make_dir(spark, f"{table}/{O.LOG_DIR}")
    text = "\n".join(json.dumps(action) for action in [info, *actions])
    storage.write_text(spark, f"{table}/{O.LOG_DIR}/{version:020d}.json", text)


def log_replay_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = _stage_log_table(spark, sf_dir)
    return O.read_snapshot(spark, table)


def log_replay_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = _stage_log_table(spark, sf_dir)
    return O.read_snapshot(spark, table, 2)


def log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows of commits 2 to 4: whole files removed, rewritten and added."""
    table, _ = _stage_log_table(spark, sf_dir)
    return _plain_time(O.read_changes(spark, table, [2, 3, 4]))


def open_table_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming job from an open table: its snapshot, as inserts, to files."""
    table, lines = _stage_log_table(spark, sf_dir)
    out = storage.scratch_dir(spark, "lineitem-copy")
    source = OpenTableSource("lineitem", table, bookmark=_STAMP)
    run(spark, [source], [FileSink("copy", "lineitem", out, "parquet")], storage.scratch_dir(spark, "job"))
    schema = C.as_inserts(lines).schema
    return _plain_time(read_batches(spark, out, "parquet", schema))


def commits_out_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy job run three times on commits whose files are the older the later their version.

    The first run takes the snapshot. Before the second, commit 3 is there without
    commit 2 and has to wait; the third has all.
    """
    table, lines, commits = _lineitem_table(spark, sf_dir)
    out, state = storage.scratch_dir(spark, "lineitem-copy"), storage.scratch_dir(spark, "job")
    source, sink = OpenTableSource("lineitem", table, bookmark=_STAMP), FileSink("copy", "lineitem", out, "parquet")
    for versions in ((0, 1), (3,), (2, 4)):
        for version in versions:
            _commit(spark, table, version, commits[version])
            storage.set_time(spark, f"{table}/{O.LOG_DIR}/{version:020d}.json", _STAMP - timedelta(days=40 * version))
        run(spark, [source], [sink], state)
    return _plain_time(read_batches(spark, out, "parquet", C.as_inserts(lines).schema))


def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of orders that each have a field of their own."""
    orders = load(spark, sf_dir, "orders")
    return union_batches(
        orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"),
        orders.where("o_orderstatus = 'O'").select("o_orderdate", "o_orderkey"),
        orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority", "o_totalprice"),
    )


def conform_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, null-typed, interval and variant columns as a CSV file holds them."""
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.struct("l_partkey", F.col("l_returnflag").alias("flag")).alias("part"),
        F.array("l_suppkey", "l_linenumber").alias("numbers"),
        F.create_map(F.col("l_linestatus"), F.col("l_linenumber")).alias("status"),
        F.lit(None).alias("nothing"),
        F.parse_json(F.concat(F.lit("["), F.col("l_partkey").cast("string"), F.lit("]"))).alias("document"),
        F.encode("l_returnflag", "utf-8").alias("raw"),
    )
    return conform(rows, "csv")


QUERIES = {
    "change_feed_normalise": change_feed_normalise,
    "change_feed_incremental": change_feed_incremental,
    "snapshot_as_inserts": snapshot_as_inserts,
    "log_replay_snapshot": log_replay_snapshot,
    "log_replay_version": log_replay_version,
    "log_changes": log_changes,
    "open_table_copy": open_table_copy,
    "commits_out_of_time": commits_out_of_time,
    "schema_merge": schema_merge,
    "conform_types": conform_types,
}

_CHANGE_CASE = """
    SELECT *, CASE o_orderstatus WHEN 'F' THEN 'insert' WHEN 'O' THEN 'update' ELSE 'delete' END AS _change_type,
"""
_LIVE = "(l_returnflag <> 'R' OR l_linestatus = 'O')"

ORACLES = {
    "change_feed_normalise": _CHANGE_CASE + "TIMESTAMP '2024-02-03 04:05:06' AS _commit_timestamp FROM orders",
    "change_feed_incremental": _CHANGE_CASE
    + "true AS stamped FROM orders WHERE year(o_orderdate) > 1997",
    "snapshot_as_inserts": """
        SELECT *, 'insert' AS _change_type, TIMESTAMP '2024-02-03 04:05:06' AS _commit_timestamp FROM customer
    """,
    "log_replay_snapshot": f"SELECT * FROM lineitem WHERE {_LIVE}",
    "log_replay_version": "SELECT * FROM lineitem WHERE l_returnflag <> 'R'",
    "log_changes": """
        SELECT *, 'delete' AS _change_type, TIMESTAMP '2023-11-14 22:13:22' AS _commit_timestamp
        FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL
        SELECT *, 'insert', TIMESTAMP '2023-11-14 22:13:24' FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'
    """,
    "open_table_copy": f"""
        SELECT *, 'insert' AS _change_type, TIMESTAMP '2024-02-03 04:05:06' AS _commit_timestamp
        FROM lineitem WHERE {_LIVE}
    """,
    "commits_out_of_time": """
        SELECT *, 'insert' AS _change_type, TIMESTAMP '2024-02-03 04:05:06' AS _commit_timestamp FROM lineitem
        UNION ALL
        SELECT *, 'delete', TIMESTAMP '2023-11-14 22:13:22' FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL
        SELECT *, 'insert', TIMESTAMP '2023-11-14 22:13:24' FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'
    """,
    "schema_merge": """
        SELECT o_orderkey, o_totalprice, CAST(NULL AS TIMESTAMP) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_orderpriority
        FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, NULL, o_orderdate, NULL FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT o_orderkey, o_totalprice, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'P'
    """,
    "conform_types": """
        SELECT l_orderkey, l_linenumber,
               '{"l_partkey":' || l_partkey || ',"flag":"' || l_returnflag || '"}' AS part,
               '[' || l_suppkey || ',' || l_linenumber || ']' AS numbers,
               '{"' || l_linestatus || '":' || l_linenumber || '}' AS status,
               CAST(NULL AS VARCHAR) AS nothing, '[' || l_partkey || ']' AS document,
               to_base64(encode(l_returnflag)) AS raw
        FROM lineitem
    """,
}
