import duckdb
import pytest
from pyspark.sql import types as T

from tidemark.llm.shared import prepare

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def given():
    """A reader of the given tables: rows of a query as a list of tuples."""
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return lambda sql: con.execute(sql).fetchall()


@pytest.fixture
def documents(llm):
    """Documents from (doc_id, text) pairs, with further columns of awkward names."""
    names = ["doc_id", "text", "n_chars", "label", "node", "component", "tile", "hash", "words", "a", "b"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), *[T.StringType()] * 8]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def make(pairs):
        rows = [(d, t, None if t is None else len(t), *["x"] * 8) for d, t in pairs]
        return llm.createDataFrame(rows, schema)

    return make
