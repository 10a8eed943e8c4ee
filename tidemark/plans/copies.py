"""Copies of whole tables: file formats, increments, destinations, failures."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark import storage
from tidemark.operators.changes import EPOCH, newer_than, next_bookmark
from tidemark.plans import load
from tidemark.sinks import open_table
from tidemark.sinks.files import FileSink, read_batches, write_batch
from tidemark.sinks.open_table import OpenTableSink
from tidemark.sources.files import FileSource, is_new, read_files
from tidemark.streaming.jobs import run

def _utc(*date: int) -> datetime:
    return datetime(*date, tzinfo=timezone.utc)


def _stage(df: DataFrame, folder: str, filetype: str = "parquet", **options) -> str:
    """Append files to a source directory; later calls give later files."""
    df.write.mode("append").format(filetype).options(**options).save(folder)
    return folder


def newest_file_time(spark: SparkSession, folder: str) -> datetime:
    """When the last file of a parquet directory was written, as a bookmark."""
    micros = F.unix_micros("_metadata.file_modification_time")
    latest = spark.read.parquet(folder).agg(F.max(micros)).first()[0]
    return EPOCH + timedelta(microseconds=latest)


def _round_trip(table: str, filetype: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, table)
        out = storage.scratch_dir(spark, f"{table}-{filetype}")
        write_batch(df, out, filetype, "copy-0")
        return read_batches(spark, out, filetype, df.schema)

    return query


def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two lots; a stream reads the files after a bookmark."""
    events = load(spark, sf_dir, "events")
    folder, out = storage.scratch_dir(spark, "events"), storage.scratch_dir(spark, "events-copy")
    _stage(events.where("ts < timestamp_ntz'2024-01-16 00:00:00'"), folder)
    source = FileSource("events", folder, "parquet", events.schema, bookmark=newest_file_time(spark, folder))
    _stage(events.where("ts >= timestamp_ntz'2024-01-16 00:00:00'"), folder)
    run(spark, [source], [FileSink("copy", "events", out, "parquet")], storage.scratch_dir(spark, "job"))
    return read_batches(spark, out, "parquet", events.schema)


def new_files_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll as a batch: customers in files older and newer than a bookmark."""
    customer = load(spark, sf_dir, "customer")
    folder = storage.scratch_dir(spark, "customers")
    _stage(customer.where("c_mktsegment IN ('AUTOMOBILE', 'BUILDING')"), folder)
    bookmark = newest_file_time(spark, folder)
    _stage(customer.where("c_mktsegment = 'FURNITURE'"), folder)
    _stage(customer.where("c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')"), folder)
    return read_files(spark, folder, "parquet", customer.schema).where(is_new(bookmark))


def _table_source(name: str, sf_dir: str, schema: T.StructType, **more) -> FileSource:
    return FileSource(name, sf_dir, "parquet", schema, options={"pathGlobFilter": f"{name}.parquet"}, **more)


def one_shot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    out = storage.scratch_dir(spark, "customer-copy")
    source = _table_source("customer", sf_dir, customer.schema, one_request=True)
    run(spark, [source], [FileSink("copy", "customer", out, "json")], storage.scratch_dir(spark, "job"))
    return read_batches(spark, out, "json", customer.schema)


def quick_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet directory to JSON destination, by a streaming job."""
    events = load(spark, sf_dir, "events")
    out = storage.scratch_dir(spark, "events-json")
    source = _table_source("events", sf_dir, events.schema)
    run(spark, [source], [FileSink("json", "events", out, "json")], storage.scratch_dir(spark, "job"))
    return read_batches(spark, out, "json", events.schema)


def rerun_no_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job run three times on its checkpoint, with new files in between."""
    orders = load(spark, sf_dir, "orders")
    folder, out, state = (storage.scratch_dir(spark, label) for label in ("orders", "orders-copy", "job"))
    source = FileSource("orders", folder, "parquet", orders.schema)
    sink = FileSink("copy", "orders", out, "parquet")
    _stage(orders.where("o_orderstatus = 'F'"), folder)
    run(spark, [source], [sink], state)
    run(spark, [source], [sink], state)
    _stage(orders.where("o_orderstatus <> 'F'"), folder)
    run(spark, [source], [sink], state)
    return read_batches(spark, out, "parquet", orders.schema)


def empty_batch_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files before the bookmark make no batch; later ones make one."""
    events = load(spark, sf_dir, "events")
    folder, out, state = (storage.scratch_dir(spark, label) for label in ("events", "events-copy", "job"))
    late = F.col("event_type").isin("purchase", "signup")
    _stage(events.where(~late), folder)
    source = FileSource("events", folder, "parquet", events.schema, bookmark=newest_file_time(spark, folder))
    sink = FileSink("copy", "events", out, "parquet")
    counts = []
    for part in (None, late):
        if part is not None:
            _stage(events.where(part), folder)
        run(spark, [source], [sink], state)
        batches = [n for n in storage.list_names(spark, out) if n.startswith("batch=")]
        rows = read_batches(spark, out, "parquet", events.schema) if batches else spark.createDataFrame([], events.schema)
        counts.append(
            rows.agg(
                F.lit(len(counts) + 1).cast("bigint").alias("run"),
                F.lit(len(batches)).cast("bigint").alias("batches"),
                F.count("*").alias("rows"),
            )
        )
    return counts[0].unionByName(counts[1])


def multi_batch_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = load(spark, sf_dir, "supplier")
    out = storage.scratch_dir(spark, "supplier")
    write_batch(supplier.where("s_acctbal < 5000"), out, "json", "j-0")
    write_batch(supplier.where("s_acctbal >= 5000 or s_acctbal is null"), out, "json", "j-1")
    return read_batches(spark, out, "json", supplier.schema)


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream of orders to every kind of destination."""
    orders = load(spark, sf_dir, "orders")
    base = storage.scratch_dir(spark, "orders")
    kinds = ("csv", "json", "avro", "parquet")
    sinks = [FileSink(kind, "orders", f"{base}/{kind}", kind) for kind in kinds]
    sinks.append(OpenTableSink("open_table", "orders", f"{base}/open_table"))
    run(spark, [_table_source("orders", sf_dir, orders.schema)], sinks, storage.scratch_dir(spark, "job"))
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    latest = F.max("o_orderdate").alias("latest")

    def counted(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(kind).alias("sink"), F.count("*").alias("rows"), price.alias("total"), latest)

    result = counted("open_table", open_table.read_table(spark, f"{base}/open_table"))
    for kind in kinds:
        result = result.unionByName(counted(kind, read_batches(spark, f"{base}/{kind}", kind, orders.schema)))
    return result


def _segment_groups(spark: SparkSession, sf_dir: str, bad: Column | None, **more) -> FileSource:
    """Customers as three groups of CSV files, of which the middle one may be
    malformed; one trigger reads one group."""
    customer = load(spark, sf_dir, "customer")
    folder = storage.scratch_dir(spark, "customer-groups")
    files = max(8, customer.rdd.getNumPartitions())
    groups = (["AUTOMOBILE", "BUILDING"], ["FURNITURE"], ["HOUSEHOLD", "MACHINERY"])
    for number, segments in enumerate(groups):
        part = customer.where(F.col("c_mktsegment").isin(segments))
        if bad is not None and number == 1:
            part = part.withColumn("c_custkey", bad)
        _stage(part.repartition(files), folder, "csv", header="true")
    return FileSource("customer", folder, "csv", customer.schema, max_files_per_trigger=files, **more)


def _with_failures(on_fail: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = _segment_groups(spark, sf_dir, F.concat(F.lit("no number "), "c_custkey"), on_fail=on_fail)
        out = storage.scratch_dir(spark, "customer-copy")
        run(spark, [source], [FileSink("copy", "customer", out, "parquet")], storage.scratch_dir(spark, "job"))
        return read_batches(spark, out, "parquet", source.schema)

    return query


class _FullSink(FileSink):
    """A destination that takes one batch and then fails."""

    def write(self, df: DataFrame, job: str, batch_id: int) -> None:
        if batch_id > 0:
            raise OSError("no space left")
        super().write(df, job, batch_id)


def sink_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A destination that fails after its first batch does not hold up the other."""
    source = _segment_groups(spark, sf_dir, None)
    base = storage.scratch_dir(spark, "customer-copy")
    sinks = [_FullSink("full", "customer", f"{base}/full", "json"), FileSink("well", "customer", f"{base}/well", "json")]
    run(spark, [source], sinks, storage.scratch_dir(spark, "job"))
    counts = [
        read_batches(spark, sink.path, "json", source.schema).agg(F.lit(sink.name).alias("sink"), F.count("*").alias("rows"))
        for sink in sinks
    ]
    return counts[0].unionByName(counts[1])


def bookmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newer_than(load(spark, sf_dir, "events"), "ts", _utc(2024, 1, 20, 12))


def bookmark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_bookmark(bookmark_rows(spark, sf_dir), "ts")


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose later files have further columns, as JSON and as Parquet, by two runs of a job."""
    orders = load(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    steps = [orders.columns[:2], orders.columns[:4], orders.columns]
    parts = [orders.where(F.col("o_orderkey") % 3 == k).select(columns) for k, columns in enumerate(steps)]
    out = []
    for kind in ("json", "parquet"):
        folder, copy, state = (storage.scratch_dir(spark, label) for label in ("orders", "orders-copy", "job"))
        source, sink = FileSource("orders", folder, kind), FileSink("copy", "orders", copy, "parquet")
        _stage(parts[0].repartition(9), folder, kind)
        _stage(parts[1].repartition(2), folder, kind)
        run(spark, [source], [sink], state)
        _stage(parts[2].repartition(2), folder, kind)
        jobs = run(spark, [source], [sink], state)
        schema = T.StructType([jobs["orders"].known_schema(spark)[name] for name in orders.columns])
        out.append(read_batches(spark, copy, "parquet", schema).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


def open_table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    path = storage.scratch_dir(spark, "orders-table")
    for number, status in enumerate(("F", "O", "P")):
        open_table.append(orders.where(F.col("o_orderstatus") == status), path, "j", number)
    return open_table.read_table(spark, path)


QUERIES = {
    "csv_roundtrip": _round_trip("orders", "csv"),
    "csv_text_roundtrip": _round_trip("documents", "csv"),
    "json_roundtrip": _round_trip("events", "json"),
    "json_text_roundtrip": _round_trip("pages", "json"),
    "avro_roundtrip": _round_trip("lineitem", "avro"),
    "avro_nested_roundtrip": _round_trip("embeddings", "avro"),
    "parquet_roundtrip": _round_trip("lineitem", "parquet"),
    "incremental_files": incremental_files,
    "new_files_batch": new_files_batch,
    "one_shot_copy": one_shot_copy,
    "quick_start": quick_start,
    "rerun_no_duplicates": rerun_no_duplicates,
    "empty_batch_suppressed": empty_batch_suppressed,
    "multi_batch_append": multi_batch_append,
    "fan_out": fan_out,
    "skip_bad_batch": _with_failures("skip"),
    "stop_bad_batch": _with_failures("stop"),
    "sink_isolation": sink_isolation,
    "bookmark_rows": bookmark_rows,
    "bookmark_advance": bookmark_advance,
    "schema_evolution": schema_evolution,
    "open_table_append": open_table_append,
}

_SINK_TOTALS = """
    SELECT '{sink}' AS sink, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           max(o_orderdate) AS latest FROM orders
"""

ORACLES = {
    "schema_evolution": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 3 = 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS o_orderdate,
               CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS o_orderpriority, kind
        FROM orders, (VALUES ('json'), ('parquet')) AS kinds(kind)
    """,
    "csv_roundtrip": "SELECT * FROM orders",
    "csv_text_roundtrip": "SELECT * FROM documents",
    "json_roundtrip": "SELECT * FROM events",
    "json_text_roundtrip": "SELECT * FROM pages",
    "avro_roundtrip": "SELECT * FROM lineitem",
    "avro_nested_roundtrip": "SELECT * FROM embeddings",
    "parquet_roundtrip": "SELECT * FROM lineitem",
    "incremental_files": "SELECT * FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15'",
    "new_files_batch": "SELECT * FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')",
    "one_shot_copy": "SELECT * FROM customer",
    "quick_start": "SELECT * FROM events",
    "rerun_no_duplicates": "SELECT * FROM orders",
    "empty_batch_suppressed": """
        SELECT CAST(1 AS BIGINT) AS run, CAST(0 AS BIGINT) AS batches, CAST(0 AS BIGINT) AS rows
        UNION ALL
        SELECT 2, 1, count(*) FROM events WHERE event_type IN ('purchase', 'signup')
    """,
    "multi_batch_append": "SELECT * FROM supplier",
    "fan_out": " UNION ALL ".join(
        _SINK_TOTALS.format(sink=sink) for sink in ("csv", "json", "avro", "parquet", "open_table")
    ),
    "skip_bad_batch": "SELECT * FROM customer WHERE c_mktsegment <> 'FURNITURE'",
    "stop_bad_batch": "SELECT * FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')",
    "sink_isolation": """
        SELECT 'full' AS sink, count(*) AS rows FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
        UNION ALL SELECT 'well', count(*) FROM customer
    """,
    "bookmark_rows": "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'",
    "bookmark_advance": "SELECT max(ts) AS bookmark FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'",
    "open_table_append": "SELECT * FROM orders",
}
