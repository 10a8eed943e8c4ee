import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.requests import bookmark_text, put_member, put_param
from tidemark.operators.changes import bookmark_literal

MOMENT = datetime(2023, 8, 1, 14, 5, 9, 26490, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "fmt",
    [
        "%Y-%m-%d %H:%M:%S UTC", "%Y-%m-%dT%H:%M:%SZ", "%d/%m/%y %I:%M %p", "%a %b %d, it's %j", "%A %B",
        "%%%Y%m%d", "%H:%M:%S.%f", "%u-%w", "plain", "%Z %z", "",
    ],
)
def test_bookmark_formats(spark, fmt):
    expected = MOMENT.strftime(fmt.replace("%f", "026490000"))
    stamp = F.to_timestamp(F.lit("2023-08-01 14:05:09.026490"))
    assert spark.range(1).select(bookmark_text(stamp, fmt)).first()[0] == expected


def test_bookmark_special_directives(spark):
    stamp = F.to_timestamp(F.lit("2023-08-01 14:05:09"))
    got = spark.range(1).select(bookmark_text(stamp, "%s|%e|%F %T|%.3f|%:z")).first()[0]
    assert got == f"{int(datetime(2023, 8, 1, 14, 5, 9, tzinfo=timezone.utc).timestamp())}| 1|2023-08-01 14:05:09|.000|+00:00"


def test_default_format_at_the_epoch(spark):
    epoch = bookmark_literal(datetime(1970, 1, 1))
    assert spark.range(1).select(bookmark_text(epoch)).first()[0] == "1970-01-01 00:00:00 UTC"


@pytest.mark.parametrize("fmt", ["%Q", "100%"])
def test_unknown_directives_are_refused(fmt):
    with pytest.raises(ValueError):
        bookmark_text(F.lit(None), fmt)


def test_put_param(spark):
    df = spark.createDataFrame([({"a": "1", "page": "0"}, "7"), (None, "7"), ({"a": "1"}, None)], "p map<string,string>, v string")
    got = [r[0] for r in df.select(put_param(F.col("p"), "page", F.col("v"))).collect()]
    assert got == [{"a": "1", "page": "7"}, {"page": "7"}, {"a": "1"}]


def test_put_member(spark):
    bodies = ['{"name":"bolt","n":{"x":1.5}}', '{"key":1}', None, "[1]", "not json", '{"a":null}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in df.select(put_member(F.col("b"), "key", F.lit('v"1'))).collect()]
    assert json.loads(got[0]) == {"name": "bolt", "n": {"x": 1.5}, "key": 'v"1'}
    assert json.loads(got[1]) == {"key": 'v"1'}
    assert json.loads(got[2]) == {"key": 'v"1'}
    assert got[3] == "[1]"
    assert got[4] == "not json"
    assert json.loads(got[5]) == {"a": None, "key": 'v"1'}
