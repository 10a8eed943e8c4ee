"""Append batches to a directory of CSV, JSON, Avro or Parquet files.

Each batch owns one directory, named after the job and the batch number, and
writing it again replaces it. A replayed batch therefore never duplicates rows,
and jobs with different checkpoints never overwrite one another.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from tidemark.functions.types import conform
from tidemark.sources.files import format_name, read_options, text_options

BATCH = "batch"


@dataclass(frozen=True)
class FileSink:
    """A destination directory fed by the source table `source`.

    A file ends after `rows_per_file` rows (0: no limit), so that text formats that
    can't be split stay readable by many tasks.
    """

    name: str
    source: str
    path: str
    filetype: str = "csv"
    on_fail: str = "stop"
    options: dict[str, str] = field(default_factory=dict)
    rows_per_file: int = 1_000_000

    def write(self, df: DataFrame, job: str, batch_id: int) -> None:
        options = {"maxRecordsPerFile": str(self.rows_per_file), **self.options}
        write_batch(df, self.path, self.filetype, batch_name(job, batch_id), options)


def batch_name(job: str, batch_id: int) -> str:
    return f"{job}-{batch_id}"


def write_batch(
    df: DataFrame, path: str, filetype: str, batch: str, options: dict[str, str] | None = None
) -> None:
    """Write one batch; a file per partition or more, published by Spark's commit."""
    writer = conform(df, filetype).write.mode("overwrite").format(format_name(df.sparkSession, filetype))
    writer = writer.options(**text_options(filetype))
    if filetype == "avro":
        writer = writer.option("compression", "snappy")
    writer.options(**(options or {})).save(f"{path.rstrip('/')}/{BATCH}={batch}")


def read_batches(
    spark: SparkSession, path: str, filetype: str, schema: T.StructType, options: dict[str, str] | None = None
) -> DataFrame:
    """All batches of a sink as one table, without the batch column."""
    reader = spark.read.format(format_name(spark, filetype)).options(**read_options(filetype))
    return reader.options(**(options or {})).schema(schema).load(path).select(*[f"`{c}`" for c in schema.names])
