"""A stream with one row per trigger: the number and time of the poll.

Spark keeps both in its own offset log, so a replayed poll has the same number
and time as before.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SOURCE_NAME = "tidemark_poll"


class _PollReader(SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"poll": 0, "time": ""}

    def read(self, start: dict):
        end = {"poll": start["poll"] + 1, "time": datetime.now(timezone.utc).isoformat()}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(start["poll"], end["time"])])


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> str:
        return "poll bigint, time string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PollReader()


def stream_polls(spark: SparkSession) -> DataFrame:
    spark.dataSource.register(PollSource)
    return spark.readStream.format(SOURCE_NAME).load()
