import pytest

from docquarry.plans import ORACLES, QUERIES
from tests.oracle import SF, compare, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name]) > 0
    else:
        assert QUERIES[name](spark, SF).collect()
