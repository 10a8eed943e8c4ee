import json

import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F, types as T

from tidemark import storage
from tidemark.sinks.files import FileSink, read_batches
from tidemark.sources import responses as P
from tidemark.sources.responses import ApiSource
from tidemark.streaming import jobs as J


ID = T.StructType().add("id", T.LongType())


def endpoints(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "endpoint string")


def answers():
    """A fetch that answers from a fixed table of pages."""

    def ids(*numbers):
        return [{"id": n} for n in numbers]

    def named(*numbers):
        return [{"id": n, "name": {"first": f"n{n}"}} for n in numbers]

    def fetch(request):
        import json

        params, body = request["params"] or {}, json.loads(request["body"] or "{}")
        name, answer = request["endpoint"], None
        if name == "/user":
            answer = {"name": "bolt", "id": 1}
        elif name == "/paged_user":
            answer = {("0", "5"): ids(1, 2, 3, 4, 5), ("1", "5"): ids(6, 7)}.get((params["page"], params["page_size"]))
        elif name == "/paged_offset_user":
            pages = {("0", "5"): named(10, 20, 30, 40, 50), ("5", "5"): named(60, 70)}
            answer = pages.get((params["offset"], params["page_size"]))
        elif name == "/paged_cursor_user":
            answer = {
                None: {"next_cursor": "1", "results": named(100, 200, 300)},
                "1": {"next_cursor": "2", "results": named(400, 500, 600)},
                "2": {"results": named(700)},
            }[params.get("cursor_key")]
        elif name == "/paged_cursor_body_user":
            answer = {None: [{"record_id": n, "name": {"first": str(n)}} for n in (100, 200, 300)],
                      "300": [{"record_id": n, "name": {"first": str(n)}} for n in (400, 500)]}[body.get("record_id")]
        elif name == "/bookmark_user":
            by_time = {"1970-01-01 00:00:00 UTC": named(1, 2), "1970-01-01T00:00:00Z": named(5, 6)}
            answer = by_time.get(body["updated_after"], named(3))
        elif name == "/down":
            return 500, "{}"
        elif name == "/broken":
            return 200, "{not json"
        elif name == "/raises":
            raise RuntimeError("connection refused")
        return (200, json.dumps(answer)) if answer is not None else (404, "")

    return fetch


def poll_rows(spark, name, **settings):
    settings = {"one_request": True, "parallelism": 2, **settings}
    source = ApiSource("t", endpoints(spark, *([name] if isinstance(name, str) else name)), answers(), **settings)
    return P.rows_of(P.poll(spark, source), source)


def test_single_request(spark):
    df = poll_rows(spark, "/user")
    assert df.columns == ["id", "name"] and rows(df) == [(1, "bolt")]


def test_page_increment(spark):
    df = poll_rows(spark, "/paged_user", pagination="page_increment")
    assert rows(df) == [(n,) for n in range(1, 8)]
    assert rows(poll_rows(spark, "/paged_user", pagination="page_increment", max_requests=1)) == [(n,) for n in range(1, 6)]
    assert rows(poll_rows(spark, "/paged_user", pagination="page_increment", wave_pages=1)) == [(n,) for n in range(1, 8)]
    assert rows(poll_rows(spark, "/paged_user", pagination="page_increment", page_number=1)) == [(6,), (7,)]


def test_offset_increment(spark):
    df = poll_rows(spark, "/paged_offset_user", pagination="offset_increment", page_token_key="offset")
    assert rows(df, "id", "name.first") == [(n, f"n{n}") for n in (10, 20, 30, 40, 50, 60, 70)]
    df = poll_rows(spark, "/paged_offset_user", pagination="offset_increment", page_token_key="offset", select_field=["name"])
    assert df.columns == ["first"] and df.count() == 7


CURSOR = dict(
    pagination="cursor", page_size=3, page_token_key="cursor_key", cursor_field=["next_cursor"],
    cursor_location="header", select_field=["results"],
)
BODY_CURSOR = dict(pagination="cursor", page_size=3, page_token_key="record_id", cursor_field=["record_id"])


def test_cursor(spark):
    assert rows(poll_rows(spark, "/paged_cursor_user", **CURSOR), "id") == [(n,) for n in range(100, 800, 100)]
    assert rows(poll_rows(spark, "/paged_cursor_user", max_requests=2, **CURSOR), "id") == [(n,) for n in range(100, 700, 100)]
    df = poll_rows(spark, "/paged_cursor_body_user", **BODY_CURSOR)
    assert rows(df, "record_id") == [(n,) for n in range(100, 600, 100)]


def test_bookmark_in_the_body(spark):
    source = ApiSource("t", endpoints(spark, "/bookmark_user"), answers(), parallelism=2, bookmark_key="updated_after")
    first = P.rows_of(P.poll(spark, source), source)
    state = P.next_state(P.poll(spark, source), source, "2024-01-01T00:00:00+00:00")
    later = P.rows_of(P.poll(spark, source, state), source)
    assert rows(first, "id") == [(1,), (2,)] and rows(later, "id") == [(3,)]
    df = poll_rows(spark, "/bookmark_user", one_request=False, bookmark_key="updated_after", bookmark_format="%Y-%m-%dT%H:%M:%SZ")
    assert rows(df, "id") == [(5,), (6,)]


def test_requests_carry_everything(spark):
    base = spark.createDataFrame(
        [("/a", {"q": "x", "page": "old"}, '{"k":1}')], "endpoint string, params map<string,string>, body string")
    source = ApiSource("t", base, answers(), pagination="offset_increment", page_size=10, offset=7, page_token_key="page")
    nothing = {"cursor": F.lit(None).cast("string"), "since": F.lit(None).cast("timestamp")}
    pages = P.expand_pages(P.with_request_columns(base).withColumns(nothing), 0, 3)
    got = P.build_requests(pages, source).orderBy("page").collect()
    assert [r["params"] for r in got] == [{"q": "x", "page_size": "10", "page": str(7 + 10 * n)} for n in range(3)]
    assert {r["body"] for r in got} == {'{"k":1,"bookmark":"1970-01-01 00:00:00 UTC"}'}
    source = ApiSource("t", base, answers(), bookmark_location="query", bookmark_key="since")
    assert P.build_requests(pages, source).first()["params"]["since"] == "1970-01-01 00:00:00 UTC"


@pytest.mark.parametrize("bad", ["/down", "/broken", "/raises", "/nowhere"])
def test_refused_responses_follow_the_policy(spark, bad):
    with pytest.raises(Exception, match="refused"):
        poll_rows(spark, [bad, "/user"]).collect()
    assert rows(poll_rows(spark, [bad, "/user"], on_fail="skip")) == [(1, "bolt")]


def test_refusals_past_the_end_do_not_count(spark):
    # pages 2 to 7 answer 404
    df = poll_rows(spark, ["/paged_user"], pagination="page_increment", wave_pages=8)
    assert df.count() == 7


def test_many_endpoints_advance_together(spark):
    def fetch(request):
        import json

        size = int(request["endpoint"][1:])
        page = int(request["params"]["page"])
        records = [{"id": n} for n in range(size)][page * 5:page * 5 + 5]
        return 200, json.dumps(records)

    names = [f"/{n}" for n in (0, 1, 4, 5, 6, 37, 100)]
    source = ApiSource("t", endpoints(spark, *names), fetch, pagination="page_increment", one_request=True, max_requests=12, wave_pages=4)
    landed = P.poll(spark, source)
    got = dict(rows(landed.groupBy("endpoint").agg(F.count("*"))))
    assert got == {"/0": 1, "/1": 1, "/4": 1, "/5": 2, "/6": 2, "/37": 8, "/100": 12}
    assert P.rows_of(landed, source, T.StructType().add("id", T.LongType())).count() == 0 + 1 + 4 + 5 + 6 + 37 + 60


def logged(folder, size, ends, cursor=None):
    """A fetch over numbered records that notes every request in a file of the test."""

    def fetch(request):
        import json
        import uuid

        params = request["params"]
        at = int(params.get("c", "0")) if cursor else int(params["page"])
        with open(f"{folder}/asked-{uuid.uuid4().hex}", "w") as note:
            note.write(f"{request['endpoint']} {at}")
        records = [{"id": n} for n in range(at * size, min(ends[request["endpoint"]], at * size + size))]
        answer = {"rows": records}
        if cursor and (at + 1) * size < ends[request["endpoint"]]:
            answer["next"] = cursor(at + 1)
        return 200, json.dumps(answer)

    return fetch


def asked(folder):
    import pathlib

    return sorted(path.read_text() for path in pathlib.Path(folder).glob("asked-*"))


def jobs_of(folder):
    import pathlib

    return len(list(pathlib.Path(folder).glob("shared/responses-*/wave=*")))


@pytest.mark.parametrize("pagination", ["page_increment", "cursor"])
def test_hundreds_of_pages_are_one_job_and_none_is_asked_for_past_the_end(spark, folder, monkeypatch, pagination):
    monkeypatch.setattr(storage, "shared_root", lambda _: f"{folder}/shared")
    ends = {"/long": 901, "/short": 3, "/even": 6, "/none": 0}
    settings = {"page_token_key": "c", "cursor_field": ["next"], "cursor_location": "query"} if pagination == "cursor" else {}
    fetch = logged(folder, 3, ends, str if pagination == "cursor" else None)
    source = ApiSource(
        "t", endpoints(spark, *ends), fetch, select_field=["rows"], schema=ID, pagination=pagination, page_size=3,
        max_requests=1000, wave_pages=1000, one_request=True, parallelism=3, **settings,
    )
    landed = P.poll(spark, source)
    got = dict(rows(P.rows_of(landed, source).groupBy("id").count().groupBy("count").count()))
    assert got == {1: 901 - 6, 2: 3, 3: 3} and jobs_of(folder) == 1
    pages = {"/long": 301, "/short": 1 if pagination == "cursor" else 2, "/even": 2 if pagination == "cursor" else 3, "/none": 1}
    assert asked(folder) == sorted(f"{name} {n}" for name, count in pages.items() for n in range(count))


def test_answers_a_task_cannot_follow_go_on_in_a_further_job(spark, folder, monkeypatch):
    """Cursors that are no plain texts or numbers are read by Spark alone; the limit still counts all pages."""
    monkeypatch.setattr(storage, "shared_root", lambda _: f"{folder}/shared")
    fetch = logged(folder, 2, {"/odd": 100}, lambda n: n if n % 3 else True)

    def named(request):
        request["params"] = {k: str(asked_for(folder)) if v == "true" else v for k, v in (request["params"] or {}).items()}
        return fetch(request)

    def asked_for(folder):
        import pathlib

        return len(list(pathlib.Path(folder).glob("asked-*")))

    source = ApiSource(
        "t", endpoints(spark, "/odd"), named, select_field=["rows"], schema=ID, pagination="cursor", page_size=2, max_requests=8,
        page_token_key="c", cursor_field=["next"], cursor_location="query", one_request=True, parallelism=2,
    )
    landed = P.poll(spark, source)
    assert rows(landed, "page") == [(n,) for n in range(8)] and jobs_of(folder) == 3
    assert rows(P.rows_of(landed, source)) == sorted(((n,) for n in range(16)), key=repr)
    assert asked(folder) == [f"/odd {n}" for n in range(8)]


@pytest.mark.parametrize(("body", "expected"), [
    ('{"a":{"rows":[1,2,3]},"next":"x"}', (True, "x")), ('{"a":{"rows":[1,2]},"next":"x"}', (False, "x")),
    ('{"a":[{"rows":1},{"rows":2},{"rows":3}],"next":7}', (True, "7")), ('{"a":[{"rows":1},{"rows":2},{}],"next":7}', (False, "7")),
    ('[[1,2],{"next":"first"},{"next":"last"}]', (True, "last")), ('{"a":{"rows":[1,2,3]},"next":null}', (False, None)),
    ('{"a":{"rows":[1,2,3]},"next":1.5}', (False, None)), ("{broken", (False, None)), ("", (False, None)), (None, (False, None)),
])
def test_what_a_task_reads_off_a_page(spark, body, expected):
    """The task's reading agrees with the columns that judge the page."""
    source = ApiSource("t", endpoints(spark, "/a"), answers(), pagination="cursor", page_size=3, select_field=["a", "rows"], cursor_field=["next"])
    assert P.next_request(source)(200, body) == expected
    assert P.next_request(source)(500, body) == (False, None) == P.next_request(source)(None, body)
    page = spark.createDataFrame([("/a", 0, None, 200, body)], P.RESPONSE_SCHEMA)
    facts = P.with_facts(page, P.fact_steps(source)).first()
    going = facts["records"] >= 3 and facts["next_cursor"] is not None
    assert going or not expected[0]
    if going and expected[0]:
        assert facts["next_cursor"] == expected[1]


def test_settings_are_checked(spark):
    with pytest.raises(ValueError):
        ApiSource("t", endpoints(spark, "/a"), answers(), pagination="x")
    with pytest.raises(ValueError):
        ApiSource("t", endpoints(spark, "/a"), answers(), pagination="cursor")
    with pytest.raises(ValueError):
        poll_rows(spark, "/a", one_request=False, bookmark_location="nowhere")
    with pytest.raises(ValueError, match="/user is listed 2 times"):
        poll_rows(spark, ["/user", "/user"])


def test_job_polls_with_a_durable_bookmark(spark, folder):
    source = ApiSource("books", endpoints(spark, "/bookmark_user"), answers(), parallelism=2, bookmark_key="updated_after")
    sink = FileSink("o", "books", f"{folder}/o", "json")
    jobs = J.run(spark, [source], [sink], f"{folder}/state")
    assert jobs["books"].reports == []
    assert rows(read_batches(spark, f"{folder}/o", "json", ID)) == [(1,), (2,)]
    J.run(spark, [source], [sink], f"{folder}/state")
    assert rows(read_batches(spark, f"{folder}/o", "json", ID)) == [(1,), (2,), (3,)]
    assert json.loads(open(f"{folder}/state/books/schema.json").read())["fields"][0]["name"] == "id"


def test_jobs_leave_no_intermediate_tables(spark, folder, monkeypatch):
    shared = f"{folder}/shared"
    monkeypatch.setattr(storage, "shared_root", lambda _: shared)
    source = ApiSource("t", endpoints(spark, "/paged_user"), answers(), parallelism=2, pagination="page_increment")
    jobs = J.run(spark, [source], [FileSink("o", "t", f"{folder}/o", "json")], f"{folder}/state")
    assert jobs["t"].reports == [] and read_batches(spark, f"{folder}/o", "json", ID).count() == 7
    assert storage.list_names(spark, shared) == []
    P.poll(spark, source)
    assert storage.list_names(spark, shared) != []


def test_job_policies(spark, folder):
    for on_fail in ("stop", "skip"):
        source = ApiSource("t", endpoints(spark, "/down"), answers(), parallelism=2, on_fail=on_fail)
        jobs = J.run(spark, [source], [FileSink("o", "t", f"{folder}/{on_fail}", "json")], f"{folder}/s-{on_fail}")
        assert [r.action for r in jobs["t"].reports] == [on_fail]


def test_job_cursor_continues_at_the_next_poll(spark, folder):
    def fetch(request):
        import json

        at = int((request["params"] or {}).get("c", "0"))
        return 200, json.dumps({"next": str(at + 2), "rows": [{"id": at}, {"id": at + 1}]})

    source = ApiSource(
        "t", endpoints(spark, "/c"), fetch, parallelism=2, pagination="cursor", page_size=2, max_requests=2, page_token_key="c",
        cursor_field=["next"], cursor_location="query", select_field=["rows"], one_request=True,
    )
    for expected in (4, 8):
        jobs = J.run(spark, [source], [FileSink("o", "t", f"{folder}/o", "json")], f"{folder}/s")
        assert jobs["t"].reports == []
        assert rows(read_batches(spark, f"{folder}/o", "json", ID)) == [(n,) for n in range(expected)]


def test_a_skipped_poll_leaves_the_bookmark_where_it_was(spark, folder):
    def fetch(request):
        import json
        import os

        asked = json.loads(request["body"])["bookmark"]
        if os.path.exists(f"{folder}/down"):
            return 503, ""
        return 200, json.dumps([{"asked": asked}])

    source = ApiSource("t", endpoints(spark, "/x"), fetch, parallelism=1, on_fail="skip")
    sink = FileSink("o", "t", f"{folder}/o", "json")
    schema = T.StructType().add("asked", T.StringType())

    def poll(down):
        (open(f"{folder}/down", "w").close() if down else None)
        jobs = J.run(spark, [source], [sink], f"{folder}/state")
        if down:
            import os

            os.remove(f"{folder}/down")
        return len(jobs["t"].reports)

    assert [poll(d) for d in (True, False, True, False)] == [1, 0, 1, 0]
    asked = rows(read_batches(spark, f"{folder}/o", "json", schema))
    assert asked[0] == ("1970-01-01 00:00:00 UTC",) and len(asked) == 2
    noted = spark.read.parquet(f"{folder}/state/t/polls/1").select(F.date_format("since", "yyyy-MM-dd HH:mm:ss 'UTC'")).first()[0]
    assert asked[1][0] == noted


def test_only_the_failed_endpoint_keeps_its_bookmark(spark):
    source = ApiSource("t", endpoints(spark, "/user", "/down"), answers(), parallelism=1, on_fail="skip")
    state = P.next_state(P.poll(spark, source), source, "2024-01-01T00:00:00+00:00")
    assert rows(state.select("endpoint", F.col("since").cast("string"), "polled")) == [
        ("/down", None, False), ("/user", "2024-01-01 00:00:00", True)]
    again = P.next_state(P.poll(spark, source, state), source, "2024-01-02T00:00:00+00:00", state)
    assert rows(again.select("endpoint", F.col("since").cast("string"))) == [("/down", None), ("/user", "2024-01-02 00:00:00")]


def test_pages_behind_the_limit_come_with_the_next_polls(spark, folder):
    def fetch(request):
        import json

        page, since = int(request["params"]["page"]), json.loads(request["body"])["bookmark"]
        ids = range(page * 2, min(23, page * 2 + 2)) if since.startswith("1970") else []
        return 200, json.dumps([{"id": n} for n in ids])

    source = ApiSource("t", endpoints(spark, "/long"), fetch, parallelism=2, pagination="page_increment", page_size=2, max_requests=4, wave_pages=3)
    sink = FileSink("o", "t", f"{folder}/o", "json")
    for expected, action in ((8, "resume"), (16, "resume"), (23, None), (23, None)):
        jobs = J.run(spark, [source], [sink], f"{folder}/s")
        assert [(report.action, report.detail[:5]) for report in jobs["t"].reports] == ([(action, "/long")] if action else [])
        assert rows(read_batches(spark, f"{folder}/o", "json", ID)) == sorted(((n,) for n in range(expected)), key=repr)


@pytest.mark.parametrize("kind", ["pages", "cursor", "resume"])
def test_polled_queries_deliver_every_order_of_a_hot_customer(spark, folder, kind):
    from tidemark.plans import responses as queries

    orders = [(k, 1 if k % 3 else k, float(k)) for k in range(30)]
    schema = "o_orderkey long, o_custkey long, o_totalprice double"
    spark.createDataFrame(orders, schema).repartition(3).write.parquet(f"{folder}/orders.parquet")
    settings = {"page_size": 2, "max_requests": 4, "wave_pages": 2, "pagination": "page_increment"}
    if kind == "cursor":
        settings |= {"pagination": "cursor", "page_token_key": "after", "cursor_field": ["next"], "cursor_location": "query"}
    fetch = queries._cursor_answer if kind == "cursor" else queries._page_answer
    query = queries._polled(fetch, **settings, **({"one_request": False} if kind == "resume" else {}))
    assert rows(query(spark, folder)) == sorted(((c, o, p) for o, c, p in orders), key=repr)


def test_large_bodies_are_handed_on_by_size():
    """A task never holds all bodies of its requests: rows go out before the next request is made."""
    asked = []
    rows_ = ((asked.append(n) or "/a", n, None, 200, body) for n, body in enumerate(["x" * 100, "x" * 60, None, "x" * 200, "x"]))
    parts = P.portions(rows_, 150)
    assert [row[1] for row in next(parts)] == [0, 1] and asked == [0, 1]
    assert [[row[1] for row in part] for part in parts] == [[2, 3], [4]]
    assert list(P.portions([])) == []


def test_request_rows_are_read_by_column():
    params = [None, {}, {"page": "1", "page_size": "5"}, {"after": None}] * 100
    rows = [(f"e{k}", k, None if k % 3 else "c", params[k], None if k % 5 else "{}") for k in range(400)]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
    columns = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in column], kind) for column, kind in zip(zip(*rows), kinds)]
    batch = pa.RecordBatch.from_arrays(columns, list(P.REQUEST))
    for start, count in ((0, 400), (3, 300), (399, 1), (5, 0)):
        for at_once in (1, 7, 256):
            assert list(P.request_rows(batch.slice(start, count), at_once)) == rows[start : start + count]
