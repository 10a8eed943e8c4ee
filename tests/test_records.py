import json

import pytest
from helpers import rows
from pyspark.sql import types as T

from tidemark.operators import records as R

USER = {"name": "bolt", "id": 1, "amount": {"count": 2, "code": "K7", "unit": "box"}}


def responses(spark, *bodies, endpoint="/user"):
    data = [(endpoint, n, None, 200, b if isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)]
    return spark.createDataFrame(data, R.RESPONSE_SCHEMA)


def table(spark, select, *bodies):
    pages = responses(spark, *bodies)
    schema = R.first_schema(pages, select)
    return R.decode(R.explode_records(R.with_selection(pages, select)), schema)


def test_one_object_is_one_row_with_sorted_columns(spark):
    df = table(spark, None, USER)
    assert df.schema.simpleString() == (
        "struct<amount:struct<code:string,count:bigint,unit:string>,id:bigint,name:string>"
    )
    assert rows(df) == [(("K7", 2, "box"), 1, "bolt")]


def test_selected_object(spark):
    assert rows(table(spark, ["amount"], USER)) == [("K7", 2, "box")]


def test_selected_in_an_array(spark):
    second = {"name": "nut", "id": 2, "amount": {"count": 2, "code": "C3", "unit": "bag"}}
    first = {**USER, "amount": {**USER["amount"], "count": 1}}
    df = table(spark, ["amount"], [first, second])
    assert rows(df) == [("C3", 2, "bag"), ("K7", 1, "box")]


def test_pages_become_one_table(spark):
    df = table(spark, ["name"], [{"id": 10, "name": {"first": "ten"}}], [{"id": 60, "name": {"first": "sixty"}}])
    assert rows(df) == [("sixty",), ("ten",)]


def test_frozen_schema_ignores_new_members_and_fills_missing_ones(spark):
    df = table(spark, None, [{"id": 1, "a": "x"}], [{"id": 2, "new": True}])
    assert rows(df, "a", "id") == [("x", 1), (None, 2)] or rows(df, "a", "id") == [(None, 2), ("x", 1)]


def test_wrong_type_fails_or_is_kept_apart(spark):
    pages = responses(spark, [{"id": 1, "n": "a"}], [{"id": "oops", "n": "b"}])
    records = R.explode_records(R.with_selection(pages))
    schema = R.first_schema(pages)
    with pytest.raises(Exception):
        R.decode(records, schema).collect()
    loose = R.decode(records, schema, "PERMISSIVE").select("id", "n", R.CORRUPT).orderBy("n").collect()
    assert tuple(loose[0]) == (1, "a", None)
    assert loose[1]["id"] is None and json.loads(loose[1][R.CORRUPT]) == {"id": "oops", "n": "b"}


def test_empty_pages_give_an_empty_schema_and_later_pages_decide(spark):
    assert R.first_schema(responses(spark, [])) == T.StructType([])
    assert R.first_schema(responses(spark, [], [{"id": 1}])).simpleString() == "struct<id:bigint>"


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"notes":[]}', "struct<notes:array<string>>"),
        ("[]", "struct<>"),
        ('{"a":null,"b":true,"c":1,"d":1.5,"e":"x"}', "struct<a:void,b:boolean,c:bigint,d:double,e:string>"),
        ('{"big":9223372036854775808,"low":-9223372036854775808}', "struct<big:double,low:bigint>"),
        ('[{"z":[1,"x"],"a":{"c":[{"q":1},{"r":2}]}},{"other":1}]', "struct<a:struct<c:array<struct<q:bigint>>>,z:array<bigint>>"),
        ("5", "struct<users:bigint>"),
        ("[1.5]", "struct<users:double>"),
        ('{"e":1e3}', "struct<e:double>"),
    ],
)
def test_document_schema(text, expected):
    assert R.document_schema(text, "users").simpleString() == expected


def test_null_typed_fields_are_read_as_text(spark):
    df = table(spark, None, [{"a": None, "id": 1}, {"a": "later", "id": 2}])
    assert rows(df) == [("later", 2), (None, 1)]


def test_weather_document(spark):
    doc = {
        "latitude": 52.5, "utc_offset_seconds": 0, "hourly": {"time": ["t0", "t1"], "temperature_2m": [1.5, 2]},
        "current": {"interval": 900, "temperature_2m": 3.25},
    }
    df = table(spark, None, doc)
    assert df.schema["hourly"].dataType.simpleString() == "struct<temperature_2m:array<double>,time:array<string>>"
    assert df.select("hourly.temperature_2m").first()[0] == [1.5, 2.0]


def test_status_and_json_policy(spark):
    data = [("/u", 0, None, 200, "{}"), ("/u", 1, None, 404, "{}"), ("/u", 2, None, 200, "{broken"),
            ("/u", 3, None, None, None), ("/u", 4, None, 299, "[1]"), ("/u", 5, None, 300, "[1]")]
    pages = spark.createDataFrame(data, R.RESPONSE_SCHEMA)
    assert rows(R.accept(pages, "skip"), "page") == [(0,), (4,)]
    assert rows(R.reject(pages), "page", "reason") == [
        (1, "status"), (2, "body is not json"), (3, "status"), (5, "status")]
    with pytest.raises(Exception, match="refused"):
        R.accept(pages, "stop").collect()


def test_endpoint_fields(spark):
    a = responses(spark, [], endpoint="/empty")
    b = responses(spark, [{"id": 1, "n": {"x": 1.5}}], [{"late": 1}], endpoint="/b")
    assert rows(R.endpoint_fields(a.union(b))) == [("/b", "id", "bigint"), ("/b", "n.x", "double")]
