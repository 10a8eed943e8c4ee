"""Paged JSON responses: a request table, a caller's fetch, a response table.

Requests are planned with Spark (one row per endpoint and page), sent on the
executors by a function the caller supplies, and landed as a table. What
follows reads that table, so a lost executor never sends a request again for
rows that were landed already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark import storage
from tidemark.functions import json_values as J
from tidemark.functions.requests import DEFAULT_BOOKMARK_FORMAT, bookmark_text, is_body, put_member, put_param
from tidemark.operators.changes import EPOCH, bookmark_literal
from tidemark.operators.pages import keep_pages
from tidemark.operators.records import (
    RESPONSE_SCHEMA, BadResponse, decode, explode_records, first_schema, is_accepted, with_selection,
)

# fetch(request) -> (status, body text); a request is a dict with the keys
# endpoint, page, cursor, params and body
Fetch = Callable[[dict], tuple[int, str]]

PAGINATIONS = ("none", "page_increment", "offset_increment", "cursor")


@dataclass(frozen=True)
class ApiSource:
    """Endpoints of a JSON API read as one table.

    `endpoints` has `endpoint string`, which must be unique, and optionally
    `params map<string,string>` and `body string`. Locations are `body`, or `query` (also called `header`).
    """

    name: str
    endpoints: DataFrame
    fetch: Fetch
    select_field: Sequence[str] | None = None
    schema: T.StructType | None = None
    bookmark: datetime = EPOCH
    bookmark_key: str = "bookmark"
    bookmark_location: str = "body"
    bookmark_format: str = DEFAULT_BOOKMARK_FORMAT
    poll_interval_ms: int = 10_000
    on_fail: str = "stop"
    one_request: bool = False
    pagination: str = "none"
    page_token_key: str = "page"
    page_number: int = 0
    page_size_key: str = "page_size"
    page_size: int = 5
    max_requests: int = 100
    offset: int = 0
    cursor_field: Sequence[str] | None = None
    cursor_record: str = "last"
    cursor_location: str = "body"
    #: Pages of an endpoint that one job may walk; longer sequences go on in a further job.
    wave_pages: int = 100
    parallelism: int | None = None
    #: A step on finished request tables that keeps rows and columns, such as a join that puts something in their bodies.
    prepare: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        if self.pagination not in PAGINATIONS:
            raise ValueError(f"pagination must be one of {PAGINATIONS}, not {self.pagination!r}")
        if self.pagination == "cursor" and not self.cursor_field:
            raise ValueError("cursor pagination needs cursor_field")


# The request table -----------------------------------------------------------

def expand_pages(endpoints: DataFrame, first: int, count: int) -> DataFrame:
    """One row per endpoint and page number; endpoints with a `resume` page count from there."""
    numbers = F.sequence(F.lit(first).cast("bigint"), F.lit(first + count - 1).cast("bigint"))
    pages = endpoints.withColumn("page", F.explode(numbers))
    return pages.withColumn("page", F.col("page") + F.col("resume")) if "resume" in endpoints.columns else pages


def page_offset(page: Column, start: int, page_size: int) -> Column:
    """The offset token of a page number counted from 0."""
    return F.lit(start).cast("bigint") + page * page_size


def place(requests: DataFrame, key: str, value: Column, location: str) -> DataFrame:
    """Put a value in the request body or among the query parameters."""
    if is_body(location):
        return requests.withColumn("body", put_member(F.col("body"), key, value))
    return requests.withColumn("params", put_param(F.col("params"), key, value))


def with_request_columns(endpoints: DataFrame) -> DataFrame:
    """The endpoint table with `params` and `body`, null where it has none."""
    if "params" not in endpoints.columns:
        endpoints = endpoints.withColumn("params", F.lit(None).cast("map<string,string>"))
    if "body" not in endpoints.columns:
        endpoints = endpoints.withColumn("body", F.lit(None).cast("string"))
    return endpoints.select("endpoint", "params", "body")


def build_requests(pages: DataFrame, source: ApiSource) -> DataFrame:
    """Finished requests from `endpoint, page, cursor, since, params, body`.

    `page` counts from 0 at the source's configured start; `since` is the
    endpoint's bookmark, null before its first poll.
    """
    return with_page(with_bookmark(pages, source), source)


def with_bookmark(requests: DataFrame, source: ApiSource) -> DataFrame:
    """The bookmark put in place; it is the same for all pages of an endpoint."""
    if source.one_request:
        return requests
    since = F.coalesce(F.col("since"), bookmark_literal(source.bookmark))
    return place(requests, source.bookmark_key, bookmark_text(since, source.bookmark_format), source.bookmark_location)


def with_page(requests: DataFrame, source: ApiSource) -> DataFrame:
    """Finished requests of endpoints that have their bookmark in place."""
    in_query = source.pagination != "cursor" or not is_body(source.cursor_location)
    if source.pagination != "none" and in_query:
        requests = place(requests, source.page_size_key, F.lit(str(source.page_size)), "query")
    if source.pagination == "page_increment":
        token = (F.col("page") + source.page_number).cast("string")
        requests = place(requests, source.page_token_key, token, "query")
    elif source.pagination == "offset_increment":
        token = page_offset(F.col("page"), source.offset, source.page_size).cast("string")
        requests = place(requests, source.page_token_key, token, "query")
    elif source.pagination == "cursor":
        requests = place(requests, source.page_token_key, F.col("cursor"), source.cursor_location)
    return requests.select("endpoint", "page", "cursor", "params", "body")


# Sending ---------------------------------------------------------------------

#: Characters of bodies that a task holds before it hands them on.
HELD_CHARS = 4 << 20


def portions(rows: Iterable[tuple], limit: int = HELD_CHARS) -> Iterator[list[tuple]]:
    """Response rows in lists that end once their bodies (the last column) reach `limit` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + len(row[-1] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


_MISSING = object()


def _at_path(value, keys: Sequence[str]):
    """What the keys lead to, each item of an array walked on its own; `_MISSING` if a step misses anywhere."""
    for depth, key in enumerate(keys):
        if isinstance(value, list):
            items = [_at_path(item, keys[depth:]) for item in value]
            return _MISSING if any(item is _MISSING for item in items) else items
        if not isinstance(value, dict) or key not in value:
            return _MISSING
        value = value[key]
    return value


def _cursor_at(value, keys: Sequence[str], at: int) -> str | None:
    """The next cursor where it is a text or a plain number, else None."""
    for key in keys:
        while isinstance(value, list):
            value = value[at] if value else None
        value = value.get(key) if isinstance(value, dict) else None
    plain = isinstance(value, str) or (type(value) is int and abs(value) < 10**18)
    return str(value) if plain else None


def next_request(source: ApiSource) -> Callable[[int | None, str | None], tuple[bool, str | None]]:
    """A function of a response that tells a task whether to ask for the next page, and with which cursor.

    It is only as clever as most answers need: what it does not follow ends the walk
    in this job, and the columns of `with_facts` decide whether a further job goes on.
    """
    size, keys, by_cursor = source.page_size, list(source.select_field or ()), source.pagination == "cursor"
    cursor_keys, at = list(source.cursor_field or ()), 0 if source.cursor_record == "first" else -1

    def after(status: int | None, body: str | None) -> tuple[bool, str | None]:
        if status is None or not 200 <= status <= 299 or body is None:
            return False, None
        try:
            value = json.loads(body)
        except ValueError:
            return False, None
        selected = _at_path(value, keys)
        selected = value if selected is _MISSING else selected
        full = (len(selected) if isinstance(selected, list) else 1) >= size
        cursor = _cursor_at(value, cursor_keys, at) if by_cursor else None
        return full and not (by_cursor and cursor is None), cursor

    return after


REQUEST = ("endpoint", "page", "cursor", "params", "body")


def request_rows(batch: pa.RecordBatch, count: int = 256) -> Iterator[tuple]:
    """The rows of a request table, read by column, `count` at a time."""
    for start in range(0, batch.num_rows, count):
        some = batch.slice(start, count)
        endpoint, cursor, body = (_texts(some.column(name)) for name in ("endpoint", "cursor", "body"))
        yield from zip(endpoint, some.column("page").to_pylist(), cursor, _dicts(some.column("params")), body, strict=True)


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _dicts(maps: pa.MapArray) -> list[dict | None]:
    """Maps as dicts; the keys and the values of all are read at once, not map by map."""
    at = maps.offsets.to_numpy().tolist()
    first, there = at[0], maps.is_valid().to_numpy(zero_copy_only=False).tolist()
    keys, values = (_texts(part.slice(first, at[-1] - first)) for part in (maps.keys, maps.items))
    return [
        dict(zip(keys[start - first : end - first], values[start - first : end - first], strict=True)) if valid else None
        for valid, start, end in zip(there, at, at[1:])
    ]


def walk(requests: DataFrame, source: ApiSource, unknown: str) -> DataFrame:
    """The response table of request rows that lie together by endpoint, in the order of their pages.

    A task walks its endpoints one after another and leaves an endpoint at its
    last page, so none waits for another and no page past the end is asked for.
    `unknown` stands in the requests for the cursor that the page before will name.
    Responses are handed on by size. A fetch that raises becomes a response
    without status, for the failure policy to judge.
    """
    fetch, after = source.fetch, next_request(source)
    quoted = json.dumps(unknown)

    def request_of(row: tuple, cursor: str | None) -> dict:
        request = dict(zip(REQUEST, row, strict=True))
        if request["cursor"] == unknown:
            request["cursor"] = cursor
            if request["params"] is not None:
                request["params"] = {key: cursor if value == unknown else value for key, value in request["params"].items()}
            if request["body"] is not None:
                request["body"] = request["body"].replace(quoted, json.dumps(cursor, ensure_ascii=False))
        return request

    def answers(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        here, going, cursor = _MISSING, False, None
        for batch in batches:
            for row in request_rows(batch):
                if row[0] != here:
                    here, going, cursor = row[0], True, None
                if not going:
                    continue
                request = request_of(row, cursor)
                asked = request["endpoint"], request["page"], request["cursor"]
                try:
                    status, body = fetch(request)
                except Exception as problem:
                    status, body = None, str(problem)
                yield *asked, status, body
                going, cursor = after(status, body)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def landed(batches):
        for rows in portions(answers(batches)):
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["endpoint", "page", "cursor", "status", "body"])

    return requests.mapInArrow(landed, RESPONSE_SCHEMA)


def plan_walks(active: DataFrame, source: ApiSource, limit: int, unknown: str) -> DataFrame:
    """The requests of the next pages, dealt to tasks by endpoint and in the order of their pages.

    `active` tells where each endpoint began (`start`) and goes on (`resume`).
    """
    tasks = source.parallelism or active.sparkSession.sparkContext.defaultParallelism
    pages = expand_pages(with_bookmark(active.repartition(tasks), source), 0, min(source.wave_pages, limit))
    pages = pages.where(F.col("page") < F.col("start") + limit)
    if source.pagination == "cursor":
        asked = F.when(F.col("page") > F.col("resume"), unknown).otherwise(F.col("cursor"))
        pages = pages.withColumn("cursor", asked)
    requests = with_page(pages, source)
    if source.prepare is None:
        return requests
    return source.prepare(requests).repartition(tasks, "endpoint").sortWithinPartitions("endpoint", "page")


LANDED_SCHEMA = f"{RESPONSE_SCHEMA}, accepted boolean, records int, next_cursor string"


def fact_steps(source: ApiSource) -> list[dict[str, Column]]:
    """The columns `with_facts` adds, step by step; built once for all waves.

    A refused response counts as shorter than any page, so it ends its
    endpoint's sequence.
    """
    following = F.lit(None).cast("string")
    if source.cursor_field:
        following = J.cursor_value(F.col("value"), source.cursor_field, source.cursor_record)
    return [
        {"accepted": is_accepted(F.col("status"), F.col("body")), "value": J.parse(F.col("body"))},
        {"selected": J.select_field(F.col("value"), source.select_field), "following": following},
        {
            "records": F.when(F.col("accepted"), J.record_count(F.col("selected"))).otherwise(-1),
            "next_cursor": F.when(F.col("accepted"), F.col("following")),
        },
    ]


def with_facts(responses: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    """Responses with `accepted, records, next_cursor`."""
    facts = reduce(DataFrame.withColumns, steps, responses)
    return facts.select(*responses.columns, "accepted", "records", "next_cursor")


def poll(spark: SparkSession, source: ApiSource, state: DataFrame | None = None) -> DataFrame:
    """All responses of one poll, landed; pages past the end already cut off.

    One job plans the requests, walks the endpoints and writes the responses with
    what they say of the next page. An endpoint whose sequence is longer than
    `wave_pages`, or whose answer a task could not follow, goes on in a further job, up to
    the request limit. `state` is what `next_state` gave for the poll before.
    """
    by_cursor = source.pagination == "cursor"
    limit = 1 if source.pagination == "none" else source.max_requests
    base = with_request_columns(source.endpoints)
    if state is None:
        nothing = {"since": F.lit(None).cast("timestamp"), "cursor": F.lit(None).cast("string"), "resume": F.lit(0).cast("bigint")}
        base = base.withColumns(nothing)
    else:
        base = base.join(_progress(state), "endpoint", "left").na.fill(0, ["resume"])
    base = active = storage.materialize(base.withColumn("start", F.col("resume")), "endpoints")
    twice = base.groupBy("endpoint").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"endpoint {twice['endpoint']} is listed {twice['count']} times")
    steps, unknown = fact_steps(source), f"cursor-{uuid.uuid4().hex}"
    land, waves, ends, beyond = storage.scratch_dir(spark, "responses"), [], [], False
    over = F.col("records") < source.page_size
    if by_cursor:
        over |= F.col("next_cursor").isNull()
    while True:
        requests = plan_walks(active, source, limit, unknown)
        waves.append(f"{land}/wave={len(waves)}")
        with_facts(walk(requests, source, unknown), steps).write.parquet(waves[-1])
        wave = spark.read.schema(LANDED_SCHEMA).parquet(waves[-1])
        seen = wave.groupBy("endpoint").agg(
            F.min(F.when(over, F.col("page"))).alias("last_page"), F.max("page").alias("reached"), F.max_by("next_cursor", "page").alias("cursor"),
        )
        seen = storage.materialize(seen, "page-ends")
        ends.append(seen.where("last_page is not null").select("endpoint", "last_page"))
        found = seen.agg(F.max(F.col("last_page").isNull()).alias("going"), F.max(F.col("reached") > F.col("last_page")).alias("beyond")).first()
        beyond = beyond or bool(found["beyond"])
        if limit == 1 or not found["going"]:
            break
        going = seen.where("last_page is null").select("endpoint", (F.col("reached") + 1).alias("resume"), "cursor")
        kept = base.drop("resume", "cursor") if by_cursor else base.drop("resume")
        active = kept.join(going if by_cursor else going.drop("cursor"), "endpoint").where(F.col("resume") < F.col("start") + limit)
        if active.isEmpty():
            break
    landed = spark.read.schema(LANDED_SCHEMA).parquet(*waves)
    if beyond and limit > 1:
        # no page past the limit was asked for, wherever the endpoints began
        landed = keep_pages(landed, reduce(DataFrame.unionByName, ends), _NO_LIMIT)
    return _judge(landed, source)


_NO_LIMIT = 2**62


def _progress(state: DataFrame) -> DataFrame:
    """`endpoint, since, cursor, resume` of a state; states written before there was a resume page start at 0."""
    resume = F.col("resume") if "resume" in state.columns else F.lit(0)
    return state.select("endpoint", "since", "cursor", resume.cast("bigint").alias("resume"))


def _judge(landed: DataFrame, source: ApiSource) -> DataFrame:
    """Apply the failure policy: a refused response stops the poll, or drops
    its endpoint from this poll."""
    refused = landed.where(~F.col("accepted")).select("endpoint", "page")
    if source.on_fail == "stop":
        first = refused.first()
        if first is not None:
            raise BadResponse(f"response of {first['endpoint']} page {first['page']} refused")
        return landed
    return landed.join(refused.select("endpoint"), "endpoint", "left_anti")


def next_state(landed: DataFrame, source: ApiSource, now: str, state: DataFrame | None = None) -> DataFrame:
    """`endpoint, since, cursor, resume, polled, unfinished` after a poll at the time `now`.

    An endpoint that answered moves its bookmark to `now` and its cursor to the
    one its last page names, if any; one left out of the poll keeps both. An
    endpoint that met the request limit with a full page is unfinished: it keeps
    its bookmark, and its next poll goes on with the page behind that one.
    """
    last = F.max_by(F.struct("next_cursor", "records", "page"), "page").alias("last")
    answered = landed.groupBy("endpoint").agg(last, F.count(F.lit(1)).alias("pages"))
    unfinished = (F.col("pages") >= source.max_requests) & (F.col("last.records") >= source.page_size)
    if source.pagination == "none":
        unfinished = F.lit(False)
    elif source.pagination == "cursor":
        unfinished &= F.col("last.next_cursor").isNotNull()
    answered = answered.select(
        "endpoint", F.col("last.next_cursor").alias("new_cursor"), F.lit(True).alias("polled"),
        unfinished.alias("unfinished"), (F.col("last.page") + 1).alias("next_page"),
    )
    before = source.endpoints.select("endpoint")
    if state is None:
        nothing = {"since": F.lit(None).cast("timestamp"), "cursor": F.lit(None).cast("string"), "resume": F.lit(0).cast("bigint")}
        before = before.withColumns(nothing)
    else:
        before = before.join(_progress(state), "endpoint", "left")
    polled = F.coalesce(F.col("polled"), F.lit(False))
    going_on = F.coalesce(F.col("unfinished"), F.lit(False))
    return before.join(answered, "endpoint", "left").select(
        "endpoint",
        F.when(polled & ~going_on, F.lit(now).cast("timestamp")).otherwise(F.col("since")).alias("since"),
        F.when(polled, F.col("new_cursor")).otherwise(F.col("cursor")).alias("cursor"),
        F.when(going_on, F.col("next_page")).when(polled, 0).otherwise(F.coalesce("resume", F.lit(0))).cast("bigint").alias("resume"),
        polled.alias("polled"),
        going_on.alias("unfinished"),
    )


def rows_of(responses: DataFrame, source: ApiSource, schema: T.StructType | None = None, mode: str = "FAILFAST") -> DataFrame:
    """The table rows in landed responses, with a frozen schema."""
    frozen = schema or source.schema or first_schema(responses, source.select_field, source.name)
    if not frozen.fields:
        return responses.sparkSession.createDataFrame([], frozen)
    return decode(explode_records(with_selection(responses, source.select_field)), frozen, mode)
