"""Append batches to an open table, created on the first batch.

With the Delta connector on the class path the table is a Delta table, with the
change feed on and the batch number as transaction version. Without it the
batches are zstd Parquet directories with the schema beside them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

from tidemark import storage
from tidemark.functions.types import conform
from tidemark.operators.schemas import SchemaConflict, fit, merge_schemas
from tidemark.sinks.files import BATCH, batch_name
from tidemark.sources.open_table import has_connector

SCHEMA_FILE = "_schema.json"

# How table files are compressed.
COMPRESSION = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}


@dataclass(frozen=True)
class OpenTableSink:
    """An open table fed by the source table `source`.

    A batch whose columns differ from the table's is refused, unless
    `merge_schema` lets new columns in.
    """

    name: str
    source: str
    path: str
    on_fail: str = "stop"
    merge_schema: bool = False

    def write(self, df: DataFrame, job: str, batch_id: int) -> None:
        append(df, self.path, job, batch_id, self.merge_schema, self.name)


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    text = storage.read_text(spark, f"{path.rstrip('/')}/{SCHEMA_FILE}")
    return None if text is None else T.StructType.fromJson(json.loads(text))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def append(
    df: DataFrame, path: str, job: str, batch_id: int, merge_schema: bool = False, name: str = "table"
) -> None:
    """Append one batch in one commit; writing a batch again changes nothing."""
    spark = df.sparkSession
    rows = conform(df, "open_table")
    if has_connector(spark):
        writer = rows.write.format("delta").mode("append").options(**COMPRESSION)
        writer = writer.option("delta.enableChangeDataFeed", "true").option("mergeSchema", str(merge_schema).lower())
        writer.option("txnAppId", f"{job}-{name}").option("txnVersion", batch_id).save(path)
        return
    stored = stored_schema(spark, path)
    table = merge_schemas(stored, _nullable(rows.schema))
    if stored is not None and not merge_schema and set(table.names) != set(stored.names):
        raise SchemaConflict(f"columns not in the table: {sorted(set(table.names) - set(stored.names))}")
    if stored is not None and not merge_schema and set(rows.columns) != set(stored.names):
        raise SchemaConflict(f"columns missing from the batch: {sorted(set(stored.names) - set(rows.columns))}")
    if table != stored:
        storage.make_dir(spark, path)
        storage.write_text(spark, f"{path.rstrip('/')}/{SCHEMA_FILE}", table.json())
    target = f"{path.rstrip('/')}/{BATCH}={batch_name(job, batch_id)}"
    fit(rows, table).write.mode("overwrite").options(**COMPRESSION).parquet(target)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The whole table, whichever way it was written."""
    schema = stored_schema(spark, path)
    if schema is None:
        return spark.read.format("delta").load(path)
    return spark.read.schema(schema).parquet(path).select(*[f"`{c}`" for c in schema.names])
