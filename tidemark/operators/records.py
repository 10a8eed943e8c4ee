"""From a response table to typed rows.

A response table has one row per response: ``endpoint string, page bigint,
cursor string, status int, body string``. Other columns pass through.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import json_values as J

CORRUPT = "_corrupt_record"

RESPONSE_SCHEMA = "endpoint string, page bigint, cursor string, status int, body string"

_LONG_MIN, _LONG_MAX = -(2**63), 2**63 - 1


class BadResponse(ValueError):
    """A response without a usable status or body."""


def is_accepted(status: Column, body: Column) -> Column:
    """True for a status in 200-299 with a body that is JSON."""
    return F.coalesce(status.between(200, 299) & J.is_json(body), F.lit(False))


def accept(responses: DataFrame, on_fail: str = "stop") -> DataFrame:
    """Keep good responses; a bad one fails the job (`stop`) or is left out (`skip`)."""
    good = is_accepted(F.col("status"), F.col("body"))
    if on_fail == "skip":
        return responses.where(good)
    if on_fail != "stop":
        raise ValueError(f"on_fail must be stop or skip, not {on_fail!r}")
    message = F.concat(
        F.lit("response of "), F.col("endpoint"), F.lit(" page "),
        F.coalesce(F.col("page").cast("string"), F.lit("?")),
        F.lit(" refused, status "), F.coalesce(F.col("status").cast("string"), F.lit("none")),
    )
    return responses.where(F.when(good, True).otherwise(F.raise_error(message).cast("boolean")))


def reject(responses: DataFrame) -> DataFrame:
    """The responses `accept(..., 'skip')` leaves out, with the reason."""
    in_range = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    reason = F.when(~in_range, "status").otherwise("body is not json")
    return responses.where(~is_accepted(F.col("status"), F.col("body"))).withColumn("reason", reason)


def with_selection(responses: DataFrame, select: Sequence[str] | None = None) -> DataFrame:
    """Replace `body` by `selected`, the part of each response that holds the data.

    Parsing is a projection of its own, so that a body is parsed once.
    """
    parsed = responses.withColumn("body", J.parse(F.col("body")))
    return parsed.withColumn("selected", J.select_field(F.col("body"), select)).drop("body")


def explode_records(selections: DataFrame) -> DataFrame:
    """One row per record, with its position `pos` in the response."""
    keep = [c for c in selections.columns if c != "selected"]
    return selections.select(*keep, F.posexplode(J.as_records(F.col("selected"))).alias("pos", "record"))


# Schema inference ------------------------------------------------------------

def value_type(value) -> T.DataType:
    """The type of one decoded JSON value; arrays go by their first element."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if _LONG_MIN <= value <= _LONG_MAX else T.DoubleType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        return T.ArrayType(value_type(value[0]) if value else T.StringType(), True)
    return T.StructType([T.StructField(k, value_type(value[k]), True) for k in sorted(value)])


def document_schema(text: str, name: str = "value") -> T.StructType:
    """The row schema of a JSON document: of its first record when it is an array.

    A document that is neither object nor array gives one column called `name`.
    """
    document = json.loads(text)
    while isinstance(document, list):
        if not document:
            return T.StructType([])
        document = document[0]
    if isinstance(document, dict):
        return value_type(document)
    return T.StructType([T.StructField(name, value_type(document), True)])


def first_schema(responses: DataFrame, select: Sequence[str] | None = None, name: str = "value") -> T.StructType:
    """Infer the schema from the first record there is, to be frozen by the caller.

    The earliest page that has records decides; one record reaches the driver.
    Landed responses carry their number of `records`, so empty pages are passed over
    without parsing anything.
    """
    keys = [c for c in ("endpoint", "page") if c in responses.columns]
    counted = responses.where("records > 0") if "records" in responses.columns else responses
    earliest = counted.agg(F.min(F.struct(*keys)).alias("key")).first()["key"] if keys else None
    candidates = [responses]
    if earliest is not None:
        # only keys are read to find the page; only that page is parsed
        match = [F.col(key).eqNullSafe(F.lit(earliest[key])) for key in keys]
        candidates.insert(0, responses.where(reduce(lambda left, right: left & right, match)))
    for pages in candidates:
        records = explode_records(with_selection(pages, select))
        first = records.orderBy(*keys, "pos").select(F.to_json("record").alias("text")).limit(1).collect()
        if first:
            return document_schema(first[0]["text"], name)
    return T.StructType([])


def flatten_schema(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every leaf field."""
    leaves: list[tuple[str, str]] = []
    for field in schema:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            leaves += flatten_schema(field.dataType, f"{path}.")
        else:
            leaves.append((path, field.dataType.simpleString()))
    return leaves


def endpoint_fields(responses: DataFrame, select: Sequence[str] | None = None) -> DataFrame:
    """Schema fields `(endpoint, path, type)` of each endpoint's first page.

    The first page is found by a partial aggregation on page numbers; only
    those pages are then parsed.
    """
    first_pages = responses.groupBy("endpoint").agg(F.min("page").alias("page"))
    firsts = responses.join(first_pages, ["endpoint", "page"], "left_semi")
    records = explode_records(with_selection(firsts, select)).where("pos = 0")
    texts = records.select("endpoint", F.to_json("record").alias("text"))

    def fields_of(batches):
        for batch in batches:
            rows = [
                (endpoint, path, kind)
                for endpoint, text in zip(batch["endpoint"], batch["text"])
                for path, kind in flatten_schema(document_schema(text))
            ]
            yield type(batch)(rows, columns=["endpoint", "path", "type"])

    return texts.mapInPandas(fields_of, "endpoint string, path string, type string")


# Decoding --------------------------------------------------------------------

def sink_ready(schema: T.StructType) -> T.StructType:
    """Null-typed fields as strings, so that a frozen schema can hold later values."""

    def ready(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.NullType):
            return T.StringType()
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(ready(kind.elementType), True)
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, ready(f.dataType), True) for f in kind])
        return kind

    return ready(schema)


def decode(records: DataFrame, schema: T.StructType, mode: str = "FAILFAST", keep: Sequence[str] = ()) -> DataFrame:
    """Records to columns with a frozen schema.

    Unknown members are ignored and missing ones are null. A value of the wrong
    type fails the job in FAILFAST; in PERMISSIVE the record keeps its readable
    members and its text goes to `_corrupt_record`.
    """
    frozen = sink_ready(schema)
    options = {"mode": mode}
    if mode == "PERMISSIVE":
        frozen = T.StructType(frozen.fields + [T.StructField(CORRUPT, T.StringType(), True)])
        options["columnNameOfCorruptRecord"] = CORRUPT
    row = F.from_json(F.to_json(F.col("record")), frozen, options)
    return records.select(*keep, row.alias("row")).select(*keep, "row.*")
