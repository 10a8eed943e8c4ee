"""Request tables, response tables and page sequences over the driver's tables.

Responses are built from `events`: an endpoint is an event type, a page holds
that type's events out of 50 consecutive event ids, so pages differ in length
and none holds more than 50 records.
"""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark import storage
from tidemark.functions import json_values as J
from tidemark.functions.requests import bookmark_text, put_member, put_param
from tidemark.operators import pages as P, records as R
from tidemark.plans import load
from tidemark.sources import responses as S
from tidemark.sources.responses import ApiSource

PAGE_SPAN = 50
PAGE_SIZE = 5


def _props_key() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _pages_of(spark: SparkSession, sf_dir: str, record: Column) -> DataFrame:
    """Response table of event pages; records are in the order of their ids."""
    events = load(spark, sf_dir, "events")
    page = F.floor(F.col("event_id") / PAGE_SPAN).cast("bigint")
    items = events.select(
        F.col("event_type").alias("endpoint"), page.alias("page"), F.struct("event_id", record.alias("record")).alias("item")
    )
    grouped = items.groupBy("endpoint", "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return grouped.select(
        "endpoint", "page", F.lit(None).cast("string").alias("cursor"), F.lit(200).alias("status"),
        F.to_json(F.transform("items", lambda item: item["record"])).alias("body"),
    )


def _plain_record() -> Column:
    return F.struct(F.col("event_id").alias("id"), _props_key().alias("k"), F.col("user_id").alias("user"), "value")


# Requests --------------------------------------------------------------------

def request_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten page requests per customer, with page number and offset tokens."""
    endpoints = load(spark, sf_dir, "customer").select(F.col("c_name").alias("endpoint"))
    requests = S.expand_pages(endpoints, 0, 10)
    return requests.withColumn("page_offset", S.page_offset(F.col("page"), 100, PAGE_SIZE))


def request_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    old = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("page"), F.lit("old"))
    fresh = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    params = F.when(F.col("c_nationkey") < 10, old).when(F.col("c_nationkey") < 20, fresh)
    built = put_param(put_param(params, "page", F.col("c_custkey").cast("string")), "page_size", F.lit("5"))
    return customer.select("c_custkey", built.alias("p")).select(
        "c_custkey",
        F.col("p")["segment"].alias("segment"),
        F.col("p")["page"].alias("page"),
        F.col("p")["page_size"].alias("page_size"),
        F.size("p").cast("bigint").alias("params"),
    )


def request_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with an old bookmark, without one, missing, and not an object."""
    orders = load(spark, sf_dir, "orders")
    old = F.to_json(F.struct(F.lit("old").alias("bookmark"), F.col("o_orderkey").alias("key")))
    fresh = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))
    body = (
        F.when(F.col("o_orderpriority").startswith("1"), old)
        .when(F.col("o_orderpriority").startswith("2"), fresh)
        .when(F.col("o_orderpriority").startswith("3"), F.lit("[1,2]"))
    )
    stamp = bookmark_text(F.col("o_orderdate"))
    return orders.select("o_orderkey", put_member(body, "bookmark", stamp).alias("body"))


def bookmark_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return load(spark, sf_dir, "events").select(
        "event_id",
        bookmark_text(ts).alias("plain"),
        bookmark_text(ts, "%Y-%m-%dT%H:%M:%SZ").alias("iso"),
        bookmark_text(ts, "%d/%m/%y %I:%M %p").alias("clock"),
        bookmark_text(ts, "%a %d %b, day %j of %Y (%%)").alias("words"),
    )


# Responses -------------------------------------------------------------------

def _mixed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per event: errors have status 500, signups a broken body for low values."""
    events = load(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_type") == "view", 204)
        .when(F.col("event_type") == "click", 302)
        .otherwise(200)
    )
    broken = (F.col("event_type") == "signup") & (F.col("value") < 20)
    return events.select(
        F.col("event_type").alias("endpoint"), F.col("event_id").alias("page"), F.lit(None).cast("string").alias("cursor"),
        status.alias("status"), F.when(broken, F.concat("props", F.lit("]"))).otherwise(F.col("props")).alias("body"),
    )


def response_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.accept(_mixed_responses(spark, sf_dir), "skip").select("endpoint", "page", "status", "body")


def response_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reject(_mixed_responses(spark, sf_dir)).select("endpoint", "page", "status", "reason")


def select_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views lack the selected field, clicks hold a null there."""
    events = load(spark, sf_dir, "events")
    data = (
        F.when(F.col("event_type") == "view", F.lit('{"other":1}'))
        .when(F.col("event_type") == "click", F.lit('{"props":null}'))
        .otherwise(F.concat(F.lit('{"props":'), "props", F.lit("}")))
    )
    body = F.concat(F.lit('{"data":'), data, F.lit(',"id":'), F.col("event_id").cast("string"), F.lit("}"))
    selected = J.select_field(J.parse(body), ["data", "props"])
    return events.select("event_id", F.to_json(selected).alias("selected"))


def select_field_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose records all have the field give the field; others stay whole."""
    name = F.when(F.col("value") >= 1, F.struct(_props_key().alias("k")))
    pages = _pages_of(spark, sf_dir, F.struct(F.col("event_id").alias("id"), name.alias("name")))
    records = R.explode_records(R.with_selection(pages, ["name"]))
    return records.select("endpoint", "page", F.col("pos").cast("bigint").alias("pos"), F.to_json("record").alias("record"))


def decode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to rows with the schema of the first record."""
    pages = _pages_of(spark, sf_dir, _plain_record())
    schema = R.first_schema(pages)
    return R.decode(R.explode_records(R.with_selection(pages)), schema, keep=["endpoint", "page"])


def decode_bad_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low values come as text where the frozen schema has a number."""
    shown = F.when(F.col("value") >= 10, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("u"), F.col("user_id")))
    events = load(spark, sf_dir, "events")
    user = F.when(F.col("value") >= 10, shown).otherwise(F.concat(F.lit('"'), shown, F.lit('"')))
    body = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"user":'), user, F.lit("}"))
    records = events.select("event_type", J.parse(body).alias("record"))
    schema = T.StructType().add("id", T.LongType()).add("user", T.LongType())
    decoded = R.decode(records, schema, "PERMISSIVE", keep=["event_type"])
    return decoded.select("event_type", "id", "user", F.col(R.CORRUPT).isNotNull().alias("corrupt"))


def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and types of each endpoint's first record."""
    high = F.col("value") > 40
    number = F.when(high, F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"'), F.col("user_id"), F.lit('"')))
    text = F.concat(
        F.lit('{"b":{"flag":true,"list":[],"x":1.5},"id":'), F.col("event_id").cast("string"),
        F.lit(',"nothing":null,"sizes":[1,2],"user":'), number, F.lit("}"),
    )
    events = load(spark, sf_dir, "events")
    page = F.floor(F.col("event_id") / PAGE_SPAN).cast("bigint")
    items = events.select(F.col("event_type").alias("endpoint"), page.alias("page"), F.struct("event_id", text.alias("t")).alias("i"))
    grouped = items.groupBy("endpoint", "page").agg(F.array_sort(F.collect_list("i")).alias("i"))
    body = F.concat(F.lit("["), F.array_join("i.t", ","), F.lit("]")).alias("body")
    return R.endpoint_fields(grouped.select("endpoint", "page", body))


def cursor_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of each page's first and last record as the next cursor."""
    pages = _pages_of(spark, sf_dir, F.struct(F.struct(F.col("event_id").alias("id")).alias("meta")))
    value = F.col("value")
    return pages.withColumn("value", J.parse(F.col("body"))).select(
        "endpoint", "page",
        J.cursor_value(value, ["meta", "id"], "first").alias("first_cursor"),
        J.cursor_value(value, ["meta", "id"], "last").alias("last_cursor"),
        J.cursor_value(value, ["meta", "none"], "last").alias("no_cursor"),
    )


# Page sequences --------------------------------------------------------------

def _with_counts(pages: DataFrame) -> DataFrame:
    return pages.withColumn("records", J.record_count(J.parse(F.col("body"))))


def _cut(max_requests: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _pages_of(spark, sf_dir, _plain_record())
        counts = _with_counts(pages).select("endpoint", "page", "records")
        kept = P.cut_pages(pages, counts, PAGE_SIZE, max_requests)
        records = R.explode_records(R.with_selection(kept))
        return records.select(
            "endpoint", "page", F.col("pos").cast("bigint").alias("pos"),
            F.variant_get("record", "$.id", "bigint").alias("event_id"),
        )

    return query


def offset_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages asked for by offset: kept responses with their token and length."""
    pages = _with_counts(_pages_of(spark, sf_dir, _plain_record()))
    kept = P.cut_pages(pages, pages.select("endpoint", "page", "records"), PAGE_SIZE, 100)
    return kept.select(
        "endpoint", S.page_offset(F.col("page"), 0, PAGE_SIZE).alias("page_offset"), F.col("records").cast("bigint").alias("records")
    )


def cursor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk along next-page cursors; a page with many records skips one page,
    so some stored pages are never reached."""
    pages = _with_counts(_pages_of(spark, sf_dir, _plain_record()))
    skip = F.when(F.col("records") > 12, 2).otherwise(1)
    links = pages.select(
        "endpoint", "page", F.when(F.col("page") > 0, F.concat(F.lit("c"), "page")).alias("cursor"),
        F.concat(F.lit("c"), F.col("page") + skip).alias("next_cursor"), "records",
    )
    walked = P.follow_cursors(links, PAGE_SIZE, 100)
    keys = (links["endpoint"] == walked["endpoint"]) & links["cursor"].eqNullSafe(walked["cursor"])
    joined = links.join(walked, keys).select(links["endpoint"], links["page"], walked["step"], links["records"])
    return joined.withColumn("records", F.col("records").cast("bigint"))


# Polling ---------------------------------------------------------------------

def _numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their place among those of their customer; one with many is numbered in parts."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    dealt = orders.repartitionByRange("o_custkey", "o_orderkey").withColumn("part", F.spark_partition_id())
    dealt = storage.materialize(dealt, "orders")
    inside = Window.partitionBy("part", "o_custkey").orderBy("o_orderkey")
    parts = dealt.groupBy("part", "o_custkey").count()
    before = Window.partitionBy("o_custkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "o_custkey", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    places = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(parts, ["part", "o_custkey"])
    return places.select(F.col("o_custkey").cast("string").alias("endpoint"), "o_orderkey", "o_totalprice", (F.col("before") + F.col("inside")).alias("place"))


def _order_pages(spark: SparkSession, sf_dir: str, page_size: int) -> tuple[DataFrame, DataFrame]:
    """An endpoint per customer, whose body tells how many orders it has, and the orders of each page."""
    orders = storage.materialize(_numbered_orders(spark, sf_dir), "numbered-orders")
    endpoints = orders.groupBy("endpoint").agg(F.count(F.lit(1)).cast("string").alias("total"))
    endpoints = endpoints.select("endpoint", F.to_json(F.struct("total")).alias("body"))
    order = F.struct("place", F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")).alias("order"))
    page = F.floor(F.col("place") / page_size).cast("bigint")
    pages = orders.groupBy("endpoint", page.alias("page")).agg(F.array_sort(F.collect_list(order)).alias("held"))
    pages = pages.select("endpoint", "page", F.to_json(F.transform("held", lambda item: item["order"])).alias("held"))
    return storage.materialize(endpoints, "customers"), storage.materialize(pages, "order-pages")


def _with_orders(pages: DataFrame):
    """Requests with the orders of their page in the body, for the answers."""

    def prepare(requests: DataFrame) -> DataFrame:
        found = requests.join(pages, ["endpoint", "page"], "left")
        return found.withColumn("body", put_member(F.col("body"), "held", F.col("held"))).select(*requests.columns)

    return prepare


def _page_answer(request: dict) -> tuple[int, str]:
    """The orders of a page; past the end, an error; nothing new for a later bookmark."""
    body, params = json.loads(request["body"]), request["params"]
    new = body.get("bookmark", "1970").startswith("1970")
    size, page = int(params["page_size"]), int(params["page"])
    if page * size > (int(body["total"]) if new else 0):
        return 404, ""
    return 200, json.dumps({"data": json.loads(body.get("held", "[]")) if new else []})


def _cursor_answer(request: dict) -> tuple[int, str]:
    body, params = json.loads(request["body"]), request["params"]
    size, start = int(params["page_size"]), int(params.get("after", "0"))
    answer = {"data": json.loads(body.get("held", "[]"))}
    if start + size < int(body["total"]):
        answer["next"] = str(start + size)
    return 200, json.dumps(answer)


def _polled(fetch, one_request: bool = True, **settings):
    """The orders that polls deliver, one after another, until no endpoint is unfinished."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        endpoints, pages = _order_pages(spark, sf_dir, settings.get("page_size", PAGE_SIZE))
        source = ApiSource(
            "orders", endpoints, fetch, select_field=["data"], one_request=one_request, prepare=_with_orders(pages),
            schema=T.StructType().add("key", T.LongType()).add("price", T.DoubleType()), **settings,
        )
        state, parts = None, []
        now = datetime(2024, 1, 1)
        while True:
            landed = S.poll(spark, source, state)
            records = R.explode_records(R.with_selection(landed, source.select_field))
            parts.append(R.decode(records, source.schema, keep=["endpoint"]))
            state = storage.materialize(S.next_state(landed, source, str(now), state), "state")
            going_on = state.where("unfinished").select("endpoint")
            if going_on.isEmpty():
                break
            if one_request:  # without a bookmark the others would answer all again
                source = replace(source, endpoints=endpoints.join(going_on, "endpoint", "left_semi"))
            now += timedelta(seconds=1)
        rows = reduce(DataFrame.unionByName, parts)
        return rows.select(F.col("endpoint").cast("bigint").alias("o_custkey"), F.col("key").alias("o_orderkey"), F.col("price").alias("o_totalprice"))

    return query


QUERIES = {
    "request_pages": request_pages,
    "request_params": request_params,
    "request_body": request_body,
    "bookmark_format": bookmark_format,
    "response_status_filter": response_status_filter,
    "response_rejects": response_rejects,
    "select_field": select_field,
    "select_field_array": select_field_array,
    "decode_records": decode_records,
    "decode_bad_record": decode_bad_record,
    "infer_schema": infer_schema,
    "cursor_value": cursor_value,
    "page_increment": _cut(100),
    "page_cutoff_limit": _cut(20),
    "offset_increment": offset_increment,
    "cursor_chain": cursor_chain,
    "polled_pages": _polled(_page_answer, pagination="page_increment", wave_pages=8),
    "polled_cursor": _polled(
        _cursor_answer, pagination="cursor", page_token_key="after", cursor_field=["next"], cursor_location="query", wave_pages=8,
    ),
    # a poll of four requests leaves most endpoints unfinished; the later ones go on
    "polled_resume": _polled(
        _page_answer, one_request=False, pagination="page_increment", page_size=5, max_requests=4,
    ),
}

_PAGES = f"""
    resp AS (
        SELECT event_type AS endpoint, event_id // {PAGE_SPAN} AS page, count(*) AS records,
               min(event_id) AS first_id, max(event_id) AS last_id, bool_and(value >= 1) AS complete
        FROM events GROUP BY ALL
    ),
    item AS (
        SELECT *, event_type AS endpoint, event_id // {PAGE_SPAN} AS page,
               row_number() OVER (PARTITION BY event_type, event_id // {PAGE_SPAN} ORDER BY event_id) - 1 AS pos
        FROM events
    )
"""


def _kept(limit: int) -> str:
    return f"""
        WITH {_PAGES},
        ends AS (SELECT endpoint, min(page) FILTER (WHERE records < {PAGE_SIZE}) AS last_page FROM resp GROUP BY endpoint),
        kept AS (
            SELECT resp.* FROM resp JOIN ends USING (endpoint)
            WHERE page < {limit} AND page <= coalesce(last_page, page)
        )
    """


_POLLED = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders"

ORACLES = {
    "request_pages": f"""
        SELECT c_name AS endpoint, page, 100 + page * {PAGE_SIZE} AS page_offset
        FROM customer, (SELECT unnest(generate_series(0, 9)) AS page)
    """,
    "request_params": """
        SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS segment,
               CAST(c_custkey AS VARCHAR) AS page, '5' AS page_size,
               CAST(CASE WHEN c_nationkey < 20 THEN 3 ELSE 2 END AS BIGINT) AS params
        FROM customer
    """,
    "request_body": """
        SELECT o_orderkey, CASE left(o_orderpriority, 1)
            WHEN '1' THEN '{"key":' || o_orderkey || ',"bookmark":"' || stamp || '"}'
            WHEN '2' THEN '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","bookmark":"' || stamp || '"}'
            WHEN '3' THEN '[1,2]'
            ELSE '{"bookmark":"' || stamp || '"}' END AS body
        FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S UTC') AS stamp FROM orders)
    """,
    "bookmark_format": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS plain, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
               strftime(ts, '%d/%m/%y %I:%M %p') AS clock, strftime(ts, '%a %d %b, day %j of %Y (%%)') AS words
        FROM events
    """,
    "response_status_filter": """
        SELECT event_type AS endpoint, event_id AS page, CAST(CASE event_type WHEN 'view' THEN 204 ELSE 200 END AS INTEGER) AS status, props AS body
        FROM events WHERE event_type IN ('view', 'purchase') OR (event_type = 'signup' AND value >= 20)
    """,
    "response_rejects": """
        SELECT event_type AS endpoint, event_id AS page,
               CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 302 ELSE 200 END AS INTEGER) AS status,
               CASE event_type WHEN 'signup' THEN 'body is not json' ELSE 'status' END AS reason
        FROM events WHERE event_type IN ('error', 'click') OR (event_type = 'signup' AND value < 20)
    """,
    "select_field": """
        SELECT event_id, CASE event_type
            WHEN 'view' THEN '{"data":{"other":1},"id":' || event_id || '}'
            WHEN 'click' THEN 'null'
            ELSE CAST(json_extract(props, '$') AS VARCHAR) END AS selected
        FROM (SELECT * REPLACE (replace(props, ' ', '') AS props) FROM events)
    """,
    "select_field_array": f"""
        WITH {_PAGES}
        SELECT endpoint, page, pos, CASE
            WHEN complete THEN '{{"k":' || k || '}}'
            WHEN value >= 1 THEN '{{"id":' || event_id || ',"name":{{"k":' || k || '}}}}'
            ELSE '{{"id":' || event_id || '}}' END AS record
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM item) JOIN resp USING (endpoint, page)
    """,
    "decode_records": f"""
        SELECT event_type AS endpoint, event_id // {PAGE_SPAN} AS page, event_id AS id,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS user, value
        FROM events
    """,
    "decode_bad_record": """
        SELECT event_type, event_id AS id, CASE WHEN value >= 10 THEN user_id END AS user, NOT (value >= 10) AS corrupt
        FROM events
    """,
    "infer_schema": """
        WITH firsts AS (SELECT event_type AS endpoint, arg_min(value, event_id) > 40 AS high FROM events GROUP BY event_type),
        field(path, type) AS (VALUES ('b.flag', 'boolean'), ('b.list', 'array<string>'), ('b.x', 'double'),
            ('id', 'bigint'), ('nothing', 'void'), ('sizes', 'array<bigint>'))
        SELECT endpoint, path, type FROM firsts, field
        UNION ALL SELECT endpoint, 'user', CASE WHEN high THEN 'bigint' ELSE 'string' END FROM firsts
    """,
    "cursor_value": f"""
        WITH {_PAGES}
        SELECT endpoint, page, CAST(first_id AS VARCHAR) AS first_cursor, CAST(last_id AS VARCHAR) AS last_cursor,
               CAST(NULL AS VARCHAR) AS no_cursor FROM resp
    """,
    "page_increment": _kept(100) + "SELECT endpoint, page, pos, event_id FROM item JOIN kept USING (endpoint, page)",
    "page_cutoff_limit": _kept(20) + "SELECT endpoint, page, pos, event_id FROM item JOIN kept USING (endpoint, page)",
    "offset_increment": _kept(100) + f"SELECT endpoint, page * {PAGE_SIZE} AS page_offset, records FROM kept",
    "cursor_chain": f"""
        WITH RECURSIVE {_PAGES},
        walk AS (
            SELECT endpoint, page, CAST(0 AS BIGINT) AS step, records FROM resp WHERE page = 0
            UNION ALL
            SELECT r.endpoint, r.page, w.step + 1, r.records FROM walk w JOIN resp r
            ON r.endpoint = w.endpoint AND r.page = w.page + CASE WHEN w.records > 12 THEN 2 ELSE 1 END
            WHERE w.records >= {PAGE_SIZE} AND w.step < 99
        )
        SELECT endpoint, page, step, records FROM walk
    """,
    "polled_pages": _POLLED,
    "polled_cursor": _POLLED,
    "polled_resume": _POLLED,
}
