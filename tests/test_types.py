import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions.types import UnsupportedTypes, conform, target_type

QUERY = """select 1 i, cast(2 as tinyint) b, cast(1.25 as decimal(5,2)) d, null n, array(null) an,
    named_struct('x', null, 'y', 1) s, map('k', null) m, parse_json('{"a":1}') v, array(parse_json('[1]')) av,
    cast('ab' as binary) bin"""


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def test_parquet_and_open_table(spark, folder):
    for sink in ("parquet", "open_table", "avro"):
        got = conform(spark.sql(QUERY), sink)
        assert kinds(got) == {
            "i": "int", "b": "tinyint", "d": "decimal(5,2)", "n": "string", "an": "array<string>",
            "s": "struct<x:string,y:int>", "m": "map<string,string>", "v": "string", "av": "array<string>", "bin": "binary",
        }
        row = got.first()
        assert row["v"] == '{"a":1}' and row["av"] == ["[1]"] and row["d"] == row["d"] and row["s"]["y"] == 1


def test_csv_holds_nested_values_as_json(spark):
    got = conform(spark.sql(QUERY), "csv")
    assert kinds(got)["s"] == kinds(got)["m"] == kinds(got)["bin"] == "string"
    assert got.first()["s"] == '{"y":1}'


def test_intervals(spark):
    df = spark.sql("select 1 id, interval '1' day as span, interval '2' year as years")
    with pytest.raises(UnsupportedTypes, match="span.*years"):
        conform(df, "open_table")
    assert kinds(conform(df, "csv"))["span"] == "string"
    assert kinds(conform(df, "parquet"))["span"] == "interval day"


def test_avro_maps_need_string_keys(spark):
    with pytest.raises(UnsupportedTypes, match="map keys"):
        conform(spark.sql("select map(1, 2) m"), "avro")


def test_time_becomes_text(spark):
    from pyspark.sql import types as T

    assert target_type(T.TimeType(), "parquet").simpleString() == "string"


def test_matching_columns_pass_untouched(spark):
    df = spark.range(3).withColumn("s", F.struct(F.lit(1).alias("a b")))
    got = conform(df.withColumnRenamed("id", "the.id"), "parquet")
    assert rows(got) == [(0, (1,)), (1, (1,)), (2, (1,))]


def test_unknown_sink(spark):
    with pytest.raises(ValueError):
        conform(spark.range(1), "xls")
