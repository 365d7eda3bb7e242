import os

import pytest

from plumbago.plans import suite
from tests.util import connect, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same(suite.queries()[name](spark, FOLDER), con, suite.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(suite.queries()) - set(suite.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert suite.queries()[name](spark, FOLDER).count() >= 0
