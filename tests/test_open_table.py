import json
import pathlib

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators.schemas import SchemaConflict
from tidemark.sinks import open_table as K
from tidemark.sources import open_table as O

SCHEMA = '{"type":"struct","fields":[{"name":"id","type":"integer","nullable":true,"metadata":{}},{"name":"name","type":"string","nullable":true,"metadata":{}}]}'


def commit(table, version, *actions):
    log = pathlib.Path(table, "_delta_log")
    log.mkdir(parents=True, exist_ok=True)
    (log / f"{version:020d}.json").write_text("\n".join(json.dumps(a) for a in actions))


def data(spark, table, name, values, change=None):
    """One parquet file below the table; returns its log path."""
    df = spark.createDataFrame(values, "id int, name string").coalesce(1)
    if change:
        df = df.withColumn("_change_type", F.lit(change[0]) if len(change) == 1 else F.element_at(F.array(*map(F.lit, change)), F.col("id") + 1))
    tmp = pathlib.Path(table, f".tmp-{name.replace('/', '-').replace(' ', '')}")
    df.write.parquet(str(tmp))
    target = pathlib.Path(table, name)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(next(tmp.glob("*.parquet")).read_bytes())
    return name


def add(path, change=True, **more):
    return {"add": {"path": path, "partitionValues": {}, "size": 1, "modificationTime": 0, "dataChange": change, **more}}


def remove(path, change=True):
    return {"remove": {"path": path, "deletionTimestamp": 0, "dataChange": change}}


def head(schema=SCHEMA, **config):
    return [
        {"commitInfo": {"timestamp": 1000}}, {"protocol": {"minReaderVersion": 1, "minWriterVersion": 4}},
        {"metaData": {"id": "x", "format": {"provider": "parquet"}, "schemaString": schema, "partitionColumns": [], "configuration": config}},
    ]


@pytest.fixture
def table(spark, folder):
    """Create, insert (0, Ash), update to (0, Elm) with a change file, append, delete a file."""
    commit(folder, 0, *head())
    commit(folder, 1, {"commitInfo": {"timestamp": 1_700_000_000_123}}, add(data(spark, folder, "a.parquet", [(0, "Ash")])))
    update = pathlib.Path(data(spark, folder, "_change_data/c.parquet", [(0, "Ash"), (1, "Elm")], ("update_preimage", "update_postimage")))
    commit(
        folder, 2, {"commitInfo": {"timestamp": 1_700_000_001_000}}, remove("a.parquet"),
        add(data(spark, folder, "b.parquet", [(0, "Elm")])), {"cdc": {"path": str(update), "partitionValues": {}, "size": 1, "dataChange": False}},
    )
    commit(folder, 3, {"commitInfo": {"timestamp": 1_700_000_002_000}}, add(data(spark, folder, "d 1+2.parquet", [(7, "Oak")]).replace(" ", "%20")))
    commit(folder, 4, {"commitInfo": {"timestamp": 1_700_000_003_000}}, remove("b.parquet"))
    commit(folder, 5, {"commitInfo": {"timestamp": 1_700_000_004_000}}, remove("d%201+2.parquet", False), add(data(spark, folder, "e.parquet", [(7, "Oak")]), False))
    return folder


def test_log_replay(spark, table):
    assert rows(O.live_files(O.read_log(spark, table))) == [("e.parquet",)]
    assert rows(O.live_files(O.read_log(spark, table, 2))) == [("b.parquet",)]
    assert rows(O.live_files(O.read_log(spark, table, 3))) == [("b.parquet",), ("d%201+2.parquet",)]


def test_add_wins_a_tie(spark, folder):
    commit(folder, 0, *head(), remove("x"), add("x"))
    assert rows(O.live_files(O.read_log(spark, folder))) == [("x",)]


def test_snapshot(spark, table):
    assert rows(O.read_snapshot(spark, table)) == [(7, "Oak")]
    assert rows(O.read_snapshot(spark, table, 3)) == [(0, "Elm"), (7, "Oak")]
    assert O.read_snapshot(spark, table, 0).isEmpty()
    changes = O.read_snapshot_changes(spark, O.OpenTableSource("t", table), 2)
    assert rows(changes.withColumn("_commit_timestamp", F.col("_commit_timestamp").cast("string"))) == [
        (0, "Elm", "insert", "1970-01-01 00:00:00")]


@pytest.mark.parametrize("small", [True, False])
def test_snapshot_of_long_and_short_lists(spark, table, monkeypatch, small):
    monkeypatch.setattr(O, "_is_small", lambda _: small)
    assert rows(O.read_snapshot(spark, table, 3)) == [(0, "Elm"), (7, "Oak")]
    assert rows(O.read_changes(spark, table, [2]), "id", "name", "_change_type") == [(1, "Elm", "update")]
    pathlib.Path(table, "b.parquet").unlink()
    with pytest.raises(FileNotFoundError, match="b.parquet"):
        O.read_snapshot(spark, table, 3)


def test_pruning_leaves_dead_files_unread(spark, table):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = O.read_snapshot(spark, table, 3)
        df.collect()
        leaf = _scan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert leaf.metrics().apply("numFiles").value() == 2


@pytest.mark.parametrize("small", [True, False])
def test_no_row_has_its_path_taken_apart(spark, folder, monkeypatch, small):
    monkeypatch.setattr(O, "_is_small", lambda _: small)
    odd = "a b+%c ü.parquet"
    data(spark, folder, odd, [(1, "a")])
    commit(folder, 0, *head(), {"commitInfo": {"timestamp": 1_700_000_000_000}}, add("a%20b+%25c%20%C3%BC.parquet"))
    for df in (O.read_snapshot(spark, folder), O.read_changes(spark, folder, [0])):
        assert rows(df, "id", "name") == [(1, "a")]
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "url" not in plan and "file_path" in plan


def _scan(df):
    """The scan of the data files in the plan."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(k) for k in range(leaves.length())]
    return next(leaf for leaf in found if "name" in list(leaf.schema().fieldNames()))


@pytest.mark.parametrize("small", [True, False])
def test_a_file_added_again_is_read_once(spark, folder, monkeypatch, small):
    monkeypatch.setattr(O, "_is_small", lambda _: small)
    name = data(spark, folder, "a.parquet", [(1, "a")])
    stamp = {"commitInfo": {"timestamp": 1_700_000_000_000}}
    commit(folder, 0, *head(), stamp, add(name))
    commit(folder, 1, stamp, remove(name))
    commit(folder, 2, stamp, add(name))
    assert rows(O.read_changes(spark, folder, [0, 1, 2]), "id", "_change_type") == [(1, "delete"), (1, "insert"), (1, "insert")]


def test_logs_with_holes_are_refused(spark, table):
    with pytest.raises(ValueError, match="no version 9"):
        O.read_snapshot(spark, table, 9)
    pathlib.Path(table, "_delta_log", f"{1:020d}.json").unlink()
    with pytest.raises(ValueError, match="lacks commits"):
        O.read_snapshot(spark, table)


def test_half_a_checkpoint_is_not_used():
    parts = [f"{3:020d}.checkpoint.{k:010d}.{2:010d}.parquet" for k in (1, 2)]
    whole = f"{1:020d}.checkpoint.parquet"
    assert O._whole_checkpoints([whole, parts[0]]) == [1]
    assert sorted(O._whole_checkpoints([whole, *parts])) == [1, 3]


def test_odd_file_names(spark, folder):
    name = data(spark, folder, "it's 100%+.parquet", [(1, "a")])
    commit(folder, 0, *head(), add("it's%20100%25+.parquet"))
    assert pathlib.Path(folder, name).exists() and rows(O.read_snapshot(spark, folder)) == [(1, "a")]


def test_changes_of_commits(spark, table):
    got = O.read_changes(spark, table, [0, 1, 2, 3, 4, 5])
    stamp = F.unix_millis("_commit_timestamp")
    assert rows(got.select("id", "name", "_change_type", stamp)) == [
        (0, "Ash", "insert", 1_700_000_000_123), (0, "Elm", "delete", 1_700_000_003_000),
        (1, "Elm", "update", 1_700_000_001_000), (7, "Oak", "insert", 1_700_000_002_000),
    ]


def test_change_files(spark, table, folder):
    new, got = O.read_change_files(spark, table)
    assert new and rows(got, "id", "name", "_change_type") == [(1, "Elm", "update")]
    new, got = O.read_change_files(spark, folder + "/nowhere")
    assert (new, got) == (False, None)


def test_checkpoint(spark, table):
    log = pathlib.Path(table, "_delta_log")
    state = O.read_log(spark, table, 3).drop("version")
    state.where("commitInfo is null").coalesce(1).write.parquet(f"{table}/.cp")
    (log / f"{3:020d}.checkpoint.parquet").write_bytes(next(pathlib.Path(table, ".cp").glob("*.parquet")).read_bytes())
    live = state.where("add.path in ('b.parquet', 'd%201+2.parquet') or metaData is not null or protocol is not null")
    live.coalesce(1).write.parquet(f"{table}/.cp2")
    (log / f"{3:020d}.checkpoint.parquet").write_bytes(next(pathlib.Path(table, ".cp2").glob("*.parquet")).read_bytes())
    for version in range(3):
        (log / f"{version:020d}.json").unlink()
    assert rows(O.read_snapshot(spark, table)) == [(7, "Oak")]
    assert rows(O.read_snapshot(spark, table, 3)) == [(0, "Elm"), (7, "Oak")]


def test_partitioned_table(spark, folder):
    schema = json.loads(SCHEMA)
    schema["fields"].append({"name": "p", "type": "integer", "nullable": True, "metadata": {}})
    commit(folder, 0, *head(json.dumps(schema)), add(data(spark, folder, "p=1/a.parquet", [(1, "a")])), add(data(spark, folder, "p=2/b.parquet", [(2, "b")])))
    commit(folder, 1, remove("p=1/a.parquet"), add(data(spark, folder, "p=3/c.parquet", [(3, "c")])))
    assert rows(O.read_snapshot(spark, folder)) == [(2, "b", 2), (3, "c", 3)]


@pytest.mark.parametrize(
    "actions",
    [
        [*head(), add("x", deletionVector={"storageType": "u"})],
        head(**{"delta.columnMapping.mode": "name"}),
        [*head(), {"protocol": {"minReaderVersion": 3, "readerFeatures": ["deletionVectors"]}}],
    ],
)
def test_connector_only_features_are_refused(spark, folder, actions):
    commit(folder, 0, *actions)
    with pytest.raises(ValueError, match="connector"):
        O.read_snapshot(spark, folder)


def test_no_log(spark, folder):
    with pytest.raises(FileNotFoundError):
        O.read_snapshot(spark, folder)


def test_create_then_append(spark, folder):
    one = spark.createDataFrame([(1, "red kite")], "id bigint, value string")
    two = spark.createDataFrame([("b", 2)], "value string, id bigint")
    K.append(one, folder, "j", 0)
    K.append(two, folder, "j", 1)
    K.append(two, folder, "j", 1)
    assert rows(K.read_table(spark, folder)) == [(1, "red kite"), (2, "b")]
    files = list(pathlib.Path(folder).rglob("*.parquet"))
    assert files and all(".zstd." in f.name for f in files)


def test_schema_changes_are_refused_unless_allowed(spark, folder):
    K.append(spark.createDataFrame([(1, "a")], "id bigint, value string"), folder, "j", 0)
    wider = spark.createDataFrame([(2, "b", True)], "id bigint, value string, extra boolean")
    for bad in (wider, wider.select("id")):
        with pytest.raises(SchemaConflict):
            K.append(bad, folder, "j", 1)
    with pytest.raises(SchemaConflict):
        K.append(wider.select(F.col("id").cast("string"), "value"), folder, "j", 1, merge_schema=True)
    K.append(wider, folder, "j", 1, merge_schema=True)
    assert rows(K.read_table(spark, folder)) == [(1, "a", None), (2, "b", True)]
