"""Every registered query against its SQL oracle, on the smallest tables."""

import pathlib
import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_every_query_has_an_oracle():
    """But for training-data operators that SQL can't express; they have tests of their own."""
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in without)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1000


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, tables, name):
    assert difference(spark, tables, entry.queries()[name], entry.oracle_sql()[name], SF) is None
