import pytest

from tests.parity import SF, connect, same
from tracewell.plans import registry


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        metafunc.parametrize("name", sorted(registry.queries()))


@pytest.fixture(scope="module")
def con():
    return connect()


def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        same(got, con.execute(sql).df())
    else:
        assert len(got) > 0


def test_entry_without_session_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
