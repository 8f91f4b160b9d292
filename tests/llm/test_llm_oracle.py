"""Every training-data query with SQL, on whole tables."""

import os

import pytest

from compare import connect, differences
from encircle.llm.oracle import ORACLE_SQL
from encircle.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not found")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    problems, count = differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE_SQL[name])
    assert not problems
    assert count > 0
