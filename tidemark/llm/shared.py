"""Helpers the operators of this package share: tables, files, text batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession

#: Text handed to Python at once. Long documents make few rows a batch.
BATCH_BYTES = 8 << 20

#: `[\x20\x09-\x0D]`, the white space of the contracts, as bytes.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes, so that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes; never less than one row."""
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI or absolute path, seen from any executor."""
    return arrow_fs.FileSystem.from_uri(uri)


def unique_name(prefix: str, suffix: str) -> str:
    """A file name no other attempt of the task uses."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_memory() -> dict:
    """What a worker process keeps between its tasks.

    This package is shipped by value, so its own globals begin anew in each task.
    """
    return vars(sys.modules.setdefault("_tidemark_worker", ModuleType("_tidemark_worker")))
