import json
import time
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import json_values as J


def select(spark, text, keys):
    value = J.select_field(J.parse(F.col("t")), keys)
    return spark.createDataFrame([(text,)], "t string").select(F.to_json(value)).first()[0]


def cursor(spark, text, keys, record="last"):
    value = J.cursor_value(J.parse(F.col("t")), keys, record)
    return spark.createDataFrame([(text,)], "t string").select(value).first()[0]


@pytest.mark.parametrize(
    "text, keys, expected",
    [
        ('{"a":{"b":1},"c":2}', ["a"], '{"b":1}'),
        ('{"a":{"b":[1,2]}}', ["a", "b"], "[1,2]"),
        ('{"a":null}', ["a"], "null"),
        # a path that is not there keeps the whole response
        ('{"a":{"b":1}}', ["x"], '{"a":{"b":1}}'),
        ('{"a":{"b":1}}', ["a", "x"], '{"a":{"b":1}}'),
        ('{"a":null}', ["a", "b"], '{"a":null}'),
        ("7", ["a"], "7"),
        # arrays are mapped over, all elements or none
        ('[{"a":1},{"a":2}]', ["a"], "[1,2]"),
        ('[{"a":1},{"b":2}]', ["a"], '[{"a":1},{"b":2}]'),
        ('[{"a":null},{"a":2}]', ["a"], "[null,2]"),
        ("[]", ["a"], "[]"),
        ('[{"a":1},7]', ["a"], '[{"a":1},7]'),
        ('[[{"a":1}],[{"a":2},{"a":3}]]', ["a"], "[[1],[2,3]]"),
        # nested arrays go on with the rest of the path
        ('{"d":[{"x":{"y":1}},{"x":{"y":2}}]}', ["d", "x", "y"], "[1,2]"),
        ('{"d":[{"x":1},{"z":2}]}', ["d", "x"], '{"d":[{"x":1},{"z":2}]}'),
        ('{"a.b":{"c d":5}}', ["a.b", "c d"], "5"),
    ],
)
def test_select_field(spark, text, keys, expected):
    assert select(spark, text, keys) == expected


def test_select_nothing_keeps_the_response(spark):
    assert select(spark, '{"a":1}', None) == '{"a":1}'


def test_arrays_of_any_depth(spark):
    deep = '{"a": [[[[[{"b": [[{"c": 1}]]}, {"b": [[{"c": 2}, {"c": 3}]]}]]]]]}'
    df = spark.createDataFrame([(deep,)], "body string").select(J.parse(F.col("body")).alias("v"))
    got = df.select(F.to_json(J.find(F.col("v"), ["a", "b", "c"])), J.cursor_value(F.col("v"), ["a", "b", "c"])).first()
    assert tuple(got) == ("[[[[[[[1]],[[2,3]]]]]]]", "3")


def test_long_missed_paths_plan_quickly(spark):
    df = spark.createDataFrame([('{"a": [1]}',)], "body string").select(J.parse(F.col("body")).alias("v"))
    began = time.time()
    assert df.select(J.find(F.col("v"), list("abcdefgh"))).first()[0] is None
    assert time.time() - began < 10


@pytest.mark.parametrize(
    "text, keys, record, expected",
    [
        ('{"next":"2","results":[]}', ["next"], "last", "2"),
        ('{"results":[]}', ["next"], "last", None),
        ('{"next":null}', ["next"], "last", None),
        ('{"meta":{"next":17}}', ["meta", "next"], "last", "17"),
        ('{"next":{"a":[1]}}', ["next"], "last", '{"a":[1]}'),
        ('{"next":true}', ["next"], "last", "true"),
        ('[{"id":100},{"id":300}]', ["id"], "last", "300"),
        ('[{"id":100},{"id":300}]', ["id"], "first", "100"),
        ("[]", ["id"], "first", None),
        ('{"r":[{"id":1},{"id":2}]}', ["r", "id"], "last", "2"),
    ],
)
def test_cursor_value(spark, text, keys, record, expected):
    assert cursor(spark, text, keys, record) == expected


def test_counts_and_records(spark):
    texts = [("[1,2,3]",), ('{"a":1}',), ("[]",), ("5",)]
    df = spark.createDataFrame(texts, "t string").select(J.parse(F.col("t")).alias("v"))
    got = df.select(J.record_count(F.col("v")), F.size(J.as_records(F.col("v")))).collect()
    assert [tuple(r) for r in got] == [(3, 3), (1, 1), (0, 0), (1, 1)]


@pytest.mark.parametrize(
    "text, valid",
    [
        ('{"a":1}', True), ("[1,2]", True), ("5", True), ('"x"', True), (" null \n", True), ("[]", True), ("{}", True),
        ('{"a":1}]', False), ('{"a":1}}', False), ('{"a":1},"x":2', False), ('{"a":1},{"a":2}', False), ("1 2", False),
        ("1],[2", False), ('1,"value":2', False), ("", False), ("   ", False), ("1]", False), ("{broken", False), (None, False),
        ("1,", False), ("nul", False), ('{"a":1} x', False), ("1] }", False), ("1} ]", False),
    ],
)
def test_is_json(spark, text, valid):
    assert spark.createDataFrame([(text,)], "t string").select(J.is_json(F.col("t"))).first()[0] is valid


def test_repeated_members_count_once(spark):
    assert select(spark, '{"a":1,"a":2}', ["a"]) == "2"


# Random documents against plain Python ---------------------------------------

MISS = object()


def random_value(rng, depth):
    kind = rng.choice(["object", "object", "array", "text", "number", "null"]) if depth else rng.choice(["text", "number", "null"])
    if kind == "object":
        return {k: random_value(rng, depth - 1) for k in rng.sample("abc", rng.randint(0, 3))}
    if kind == "array":
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {"text": rng.choice(["x", "", '"q"']), "number": rng.choice([0, -5, 12]), "null": None}[kind]


def follow(value, keys):
    """The selected part, or MISS."""
    if not keys:
        return value
    if isinstance(value, dict):
        return follow(value[keys[0]], keys[1:]) if keys[0] in value else MISS
    if isinstance(value, list):
        found = [follow(item, keys) for item in value]
        return MISS if any(f is MISS for f in found) else found
    return MISS


def ask_record(value, keys, record):
    """The cursor in the first or last record, or None."""
    if not keys:
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, sort_keys=True, separators=(",", ":"))
    if isinstance(value, dict):
        return ask_record(value[keys[0]], keys[1:], record) if keys[0] in value else None
    if isinstance(value, list) and value:
        return ask_record(value[0 if record == "first" else -1], keys, record)
    return None


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["c", "a", "b"]])
def test_random_documents(spark, keys):
    rng = random.Random(len(keys))
    documents = [random_value(rng, 3) for _ in range(400)]
    df = spark.createDataFrame([(n, json.dumps(d)) for n, d in enumerate(documents)], "n int, t string").repartition(2)
    value = F.col("v")
    got = df.select("n", J.parse(F.col("t")).alias("v")).select(
        "n", F.to_json(J.select_field(value, keys)), J.cursor_value(value, keys, "first"), J.cursor_value(value, keys, "last")
    )
    for n, selected, first, last in got.collect():
        document = documents[n]
        found = follow(document, keys)
        assert json.loads(selected) == (document if found is MISS else found), document
        assert first == ask_record(document, keys, "first"), document
        assert last == ask_record(document, keys, "last"), document
