import os
import pathlib
from datetime import datetime, timezone

import pytest
from helpers import rows
from pyspark.sql import functions as F, types as T

from tidemark import storage
from tidemark.sinks.files import read_batches, write_batch
from tidemark.sources import files as S
from tidemark.sources.files import FileSource


def put(folder, name, text, day=None):
    path = pathlib.Path(folder, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    if day is not None:
        moment = datetime(2024, 1, day, tzinfo=timezone.utc).timestamp()
        os.utime(path, (moment, moment))
    return str(path)


def two_files(folder):
    put(folder, "test_1.csv", "id,value\n1,red kite\n2,grey owl\n", 1)
    put(folder, "test_2.csv", "id,value\n3,tern\n", 3)


def test_csv_table(spark, folder):
    two_files(folder)
    df = S.read_files(spark, folder)
    assert df.schema.simpleString() == "struct<id:bigint,value:string>"
    assert rows(df) == [(1, "red kite"), (2, "grey owl"), (3, "tern")]


def test_json_table(spark, folder):
    put(folder, "a.json", '{"id":1,"value":"red kite"}\n{"id":2,"value":"grey owl"}\n')
    put(folder, "b.json", '{"id":3,"value":"tern"}\n')
    df = S.read_files(spark, folder, "json")
    assert df.schema.simpleString() == "struct<id:bigint,value:string>"
    assert rows(df) == [(1, "red kite"), (2, "grey owl"), (3, "tern")]


@pytest.mark.parametrize("filetype", ["csv", "json", "avro", "parquet"])
def test_round_trip(spark, folder, filetype):
    df = spark.sql(
        """select * from values
        (1L, 'plain', 1.5D, timestamp_ntz'2024-01-01 00:00:00.000001', timestamp'2024-02-03 04:05:06.123456', date'2024-01-01', true),
        (2L, 'bon après-midi, "quoted" \\\\ back', -0.1D, null, null, null, null),
        (3L, null, 1e300D, timestamp_ntz'1969-12-31 23:59:59.999999', timestamp'1970-01-01 00:00:00', date'1970-01-01', false),
        (4L, '', 0D, null, null, null, false)
        t(id, value, x, ntz, ltz, d, b)"""
    )
    write_batch(df, folder, filetype, "j-0")
    back = read_batches(spark, folder, filetype, df.schema)
    assert rows(back) == rows(df)


def test_non_recursive_and_hidden(spark, folder):
    two_files(folder)
    put(folder, "deeper/test_3.csv", "id,value\n9,no\n")
    put(folder, "_hidden.csv", "id,value\n8,no\n")
    assert S.read_files(spark, folder, schema=T.StructType.fromDDL("id bigint, value string")).count() == 3


def test_bookmark_is_strict_and_leaves_old_files_out(spark, folder):
    two_files(folder)
    new, df = S.read_new_files(spark, FileSource("t", folder, bookmark=datetime(2024, 1, 1, tzinfo=timezone.utc)))
    assert new and rows(df) == [(3, "tern")]
    new, df = S.read_new_files(spark, FileSource("t", folder, bookmark=datetime(2024, 1, 3)))
    assert not new and rows(df) == []
    new, df = S.read_new_files(spark, FileSource("t", folder))
    assert new and len(rows(df)) == 3


def test_bookmark_prunes_files_in_the_scan(spark, folder):
    two_files(folder)
    df = S.read_files(spark, folder).where(S.is_new(datetime(2024, 1, 1)))
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "file_modification_time" in scan
    files = [df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()]
    assert files == [1]


def test_empty_directory(spark, folder):
    new, df = S.read_new_files(spark, FileSource("t", folder))
    assert not new and df.isEmpty()
    with pytest.raises(FileNotFoundError):
        S.infer_schema(spark, folder)


def test_malformed_rows_are_never_turned_into_nulls(spark, folder):
    put(folder, "a.csv", "id,value\n1,a\nx,b\n")
    schema = T.StructType.fromDDL("id bigint, value string")
    with pytest.raises(Exception):
        S.read_files(spark, folder, schema=schema).collect()


def test_csv_columns_in_another_order_are_noticed(spark, folder):
    put(folder, "a.csv", "id,value\n1,a\n")
    put(folder, "b.csv", "value,id\n2,3\n")
    with pytest.raises(Exception):
        S.read_files(spark, folder, schema=T.StructType.fromDDL("id bigint, value string")).collect()


def test_csv_texts_with_line_breaks(spark, folder):
    df = spark.createDataFrame([(1, 'a\nb,"c"\r\n\n'), (2, "\\"), (3, '"'), (4, "  x "), (5, " "), (6, ",,"), (7, "#c")], "id bigint, value string")
    write_batch(df, folder, "csv", "j-0")
    assert rows(read_batches(spark, folder, "csv", df.schema)) == rows(df)


def test_unknown_file_type(spark):
    with pytest.raises(ValueError):
        S.format_name(spark, "xls")


def test_batches_append_and_replays_replace(spark, folder):
    first = spark.createDataFrame([(1, "a")], "id bigint, value string")
    second = spark.createDataFrame([(4, "un héron cendré")], "id bigint, value string")
    for _ in range(2):
        write_batch(first, folder, "json", "j-0")
    write_batch(second, folder, "json", "j-1")
    write_batch(second, folder, "json", "other-0")
    assert rows(read_batches(spark, folder, "json", first.schema)) == [
        (1, "a"), (4, "un héron cendré"), (4, "un héron cendré")]


def test_split_unreadable(spark, folder):
    paths = [put(folder, f"f{n}.csv", f"id,value\n{n},a\n") for n in range(6)]
    put(folder, "f2.csv", "id,value\nbad\n")
    put(folder, "f5.csv", "id,value\nbad,1,2\n")
    source = FileSource("t", folder)
    good, bad = S.split_unreadable(spark, paths, source, T.StructType.fromDDL("id bigint, value string"))
    assert [os.path.basename(p) for p in bad] == ["f2.csv", "f5.csv"] and len(good) == 4


def test_storage(spark, folder):
    path = f"{folder}/a/text"
    storage.make_dir(spark, f"{folder}/a")
    assert storage.read_text(spark, path) is None and not storage.exists(spark, path)
    storage.write_text(spark, path, "é1")
    storage.write_text(spark, path, "é2")
    assert storage.read_text(spark, path) == "é2" and storage.list_names(spark, f"{folder}/a") == ["text"]
    assert storage.list_names(spark, f"{folder}/none") == []
    table = storage.materialize(spark.range(3).withColumn("x", F.lit("y")), "t")
    assert rows(table) == [(0, "y"), (1, "y"), (2, "y")]


class _Session:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = conf, self
        self.master = master


def test_shared_folder_comes_from_the_session(spark, folder):
    assert storage.scratch_dir(_Session("spark://x", **{"spark.checkpoint.dir": folder}), "x").startswith(folder)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_dir(_Session("spark://x"), "x")
    assert storage.scratch_dir(spark, "x") != storage.scratch_dir(spark, "x")


def test_single_line_csv_is_read_by_many_tasks(spark, folder):
    put(folder, "a.csv", "id,value\n" + "".join(f"{n},text {n}\n" for n in range(40_000)))
    schema = T.StructType.fromDDL("id bigint, value string")
    source = FileSource("a", folder, schema=schema, multi_line=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = S.read_files(spark, folder, "csv", schema, source.read_options())
        assert df.rdd.getNumPartitions() > 4
        assert df.agg(F.sum("id"), F.count("value")).first() == (40_000 * 39_999 // 2, 40_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_columns_of_all_files_are_kept(spark, folder):
    for kind in ("json", "parquet", "avro"):
        for k in range(3):
            row = spark.createDataFrame([(k, *["x"] * k)], ["id", "a", "b"][: k + 1])
            write_batch(row, f"{folder}/{kind}", kind, f"j-{k}")
        files = [f"{folder}/{kind}/batch=j-{k}" for k in range(3)]
        df = S.read_files(spark, files, kind)
        assert sorted(df.columns) == ["a", "b", "id"]
        assert rows(df, "id", "a", "b") == [(0, None, None), (1, "x", None), (2, "x", "x")]
