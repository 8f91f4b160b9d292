import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from encircle.catalog.oracle import ORACLE_SQL
from encircle.catalog.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not found")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    problems, count = differences(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name])
    assert not problems
    assert count > 0
