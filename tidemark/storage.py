"""Small filesystem helpers over the Hadoop FileSystem API, plus scratch tables.

Everything here works on the cluster's shared filesystem as well as on local
paths; only metadata (names, existence, times, a schema text) passes through
the driver.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

_local_scratch: str | None = None
_scope = threading.local()


def _locate(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _locate(spark, path)
    return fs.exists(jpath)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a directory (empty when it does not exist)."""
    fs, jpath = _locate(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(jpath))


def matching_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files a glob pattern matches."""
    fs, jpattern = _locate(spark, pattern)
    return sorted(status.getPath().getName() for status in fs.globStatus(jpattern) or [])


def make_dir(spark: SparkSession, path: str) -> str:
    fs, jpath = _locate(spark, path)
    fs.mkdirs(jpath)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file in one step (write aside, then rename over it)."""
    fs, jpath = _locate(spark, path)
    _, aside = _locate(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    modes = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    modes[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    qualified = fs.makeQualified(jpath)
    context = hadoop.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), qualified, modes)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, jpath = _locate(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def set_time(spark: SparkSession, path: str, time: datetime) -> None:
    """Set the modification time of a file, where the file system has one to set."""
    fs, jpath = _locate(spark, path)
    fs.setTimes(jpath, int(time.timestamp() * 1000), -1)


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _locate(spark, path)
    fs.delete(jpath, True)


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints and intermediate tables."""
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="tidemark-")
    return _local_scratch


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """Delete the scratch paths made inside, once the block is left.

    For jobs that run for ever: what a batch needs only while it is written
    must not pile up.
    """
    outer = getattr(_scope, "paths", None)
    _scope.paths = []
    try:
        yield
    finally:
        for path in _scope.paths:
            delete(spark, path)
        _scope.paths = outer


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Later joins then plan with the real size of the table, so a broadcast is
    chosen only when Spark has seen that it is small, and a lost executor
    recomputes from files rather than from the whole history.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
