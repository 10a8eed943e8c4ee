"""What the physical plans must look like."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.operators import changes as C, pages as P, records as R
from tidemark.sources import open_table as O


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_bookmark_reaches_the_scan(spark, folder):
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' ts, 1 id, 2 unused").write.parquet(folder + "/t")
    df = C.newer_than(spark.read.parquet(folder + "/t"), "ts", datetime(2024, 1, 1, tzinfo=timezone.utc)).select("id")
    assert "GreaterThan(ts,2024-01-01T00:00)" in plan(df)
    assert "unused" not in plan(df) and "Exchange" not in plan(df)
    df = C.next_bookmark(C.newer_than(spark.read.parquet(folder + "/t"), "ts", datetime(2024, 1, 1)), "ts")
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan(df)


def test_change_filter_reaches_the_scan(spark, folder):
    spark.sql("select 1 id, 'insert' _change_type").write.parquet(folder + "/t")
    text = plan(C.normalise(spark.read.parquet(folder + "/t")))
    assert "Not(EqualTo(_change_type,update_preimage))" in text and "Exchange" not in text


def test_record_operators_do_not_shuffle(spark):
    pages = spark.createDataFrame([("/a", 0, None, 200, '[{"a":{"b":1}}]')], R.RESPONSE_SCHEMA)
    good = R.accept(pages, "skip")
    rows = R.decode(R.explode_records(R.with_selection(good, ["a"])), R.document_schema('{"b":1}'))
    assert "Exchange" not in plan(rows) and "Python" not in plan(rows)


def test_page_ends_aggregate_before_the_shuffle(spark):
    counts = spark.createDataFrame([("a", 1, 2)], "endpoint string, page bigint, records int")
    text = plan(P.last_pages(counts, 5))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_page_cut_broadcasts_what_was_measured(spark):
    pages = spark.range(100).select(F.concat(F.lit("a"), "id").alias("endpoint"), F.col("id").alias("page"), F.lit(5).alias("records"))
    text = plan(P.cut_pages(pages, pages, 5, 10))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        assert "SortMergeJoin" in plan(P.cut_pages(pages, pages, 5, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_live_files_aggregate_before_the_shuffle(spark):
    log = spark.createDataFrame([], f"{O._ACTION}, version bigint")
    text = plan(O.live_files(log))
    assert text.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" in text and "SortAggregate" not in text and "Window" not in text
