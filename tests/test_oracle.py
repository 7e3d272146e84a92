"""Every registered query against its SQL, on the given tables."""

import pytest
from compare import connect, difference
from conftest import SF_DIR

from tidefeed.workload.oracle import ORACLE
from tidefeed.workload.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None
