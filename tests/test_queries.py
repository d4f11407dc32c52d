"""Every registered query beside its SQL twin, on the smallest data."""

import os

import pytest

from checks.catalog import QUERIES
from checks.compare import database, difference
from checks.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["tag_id", "variable_id", "result", "error"]
    assert entry.queries().keys() >= entry.oracle_sql().keys() >= ORACLES.keys()
