"""Every registered query against its SQL at the smallest size."""

import pytest

import __spark_entry__
from checks.compare import connect, difference
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    actual = __spark_entry__.queries()[name](spark, SF_DIR).toPandas()
    expected = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    assert difference(actual, expected) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
