import pytest
from sqlcheck import assert_same, connect

from weftline.queries import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    found = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        assert_same(found, con, ORACLE_SQL[name])
    else:
        assert found.count() > 0


def test_flagship_is_a_query():
    assert FLAGSHIP in QUERIES
