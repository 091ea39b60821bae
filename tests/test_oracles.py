"""Every registered query against its SQL, over whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    assert difference(queries()[name](spark, FOLDER), oracle, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert not entry(spark).isEmpty()
