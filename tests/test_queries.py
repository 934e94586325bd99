import pytest

from oracle import connect, differences
from spanloom.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, con, data, name):
    assert differences(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], data) == ([], [], 0)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
