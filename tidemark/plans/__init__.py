"""Ready queries: the operators run over the driver's tables.

Each module has `QUERIES` (name to a callable of session and table directory)
and `ORACLES` (name to the same result in plain SQL).
"""

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import apply_settings


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
