from datetime import datetime, timezone

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import changes as C, schemas as S


def test_normalise(spark):
    feed = spark.createDataFrame(
        [(1, "insert"), (2, "update_preimage"), (2, "update_postimage"), (3, "delete"), (4, None)],
        "id int, _change_type string",
    )
    got = C.normalise(feed, datetime(2024, 1, 2, 3, 4, 5, 900000, tzinfo=timezone.utc))
    assert rows(got, "id", "_change_type") == [(1, "insert"), (2, "update"), (3, "delete")]
    assert {str(r[0]) for r in got.select(F.col("_commit_timestamp").cast("string")).collect()} == {"2024-01-02 03:04:05"}


def test_normalise_keeps_a_real_commit_time(spark):
    feed = spark.sql("select 1 id, 'insert' _change_type, timestamp'2024-05-05 00:00:00' _commit_timestamp union all select 2, 'insert', null")
    got = C.normalise(feed).select("id", F.col("_commit_timestamp").cast("string"))
    assert rows(got) == [(1, "2024-05-05 00:00:00"), (2, "1970-01-01 00:00:00")]


def test_as_inserts(spark):
    got = C.as_inserts(spark.createDataFrame([(0, "Elm")], "id int, name string"))
    assert got.schema.simpleString() == "struct<id:int,name:string,_change_type:string,_commit_timestamp:timestamp>"
    assert not got.schema["_change_type"].nullable and not got.schema["_commit_timestamp"].nullable
    assert rows(got.withColumn("_commit_timestamp", F.col("_commit_timestamp").cast("string"))) == [
        (0, "Elm", "insert", "1970-01-01 00:00:00")
    ]


def test_row_bookmark(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2024-01-02 00:00:00.000001') t(id, ts)")
    bookmark = datetime(2024, 1, 2, tzinfo=timezone.utc)
    newer = C.newer_than(df, "ts", bookmark)
    assert rows(newer, "id") == [(2,)]
    assert C.next_bookmark(newer, "ts").first()[0] == datetime(2024, 1, 2, 0, 0, 0, 1)
    assert C.newer_than(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", bookmark).count() == 1


def test_merge_schemas(spark):
    one = spark.createDataFrame([(1, 2)], "id bigint, values bigint")
    two = spark.createDataFrame([(3, 4)], "id bigint, meta bigint")
    assert S.merge_schemas(one.schema, two.schema).simpleString() == "struct<id:bigint,values:bigint,meta:bigint>"
    assert rows(S.union_batches(one, two)) == [(1, 2, None), (3, None, 4)]
    assert S.union_batches(one, two).columns == ["id", "values", "meta"]
    assert rows(S.fit(two, S.merge_schemas(one.schema, two.schema))) == [(3, None, 4)]


def test_conflicting_types_are_refused(spark):
    one = spark.createDataFrame([(1,)], "id bigint")
    two = spark.createDataFrame([("x",)], "id string")
    with pytest.raises(S.SchemaConflict, match="id: bigint and string"):
        S.union_batches(one, two)
