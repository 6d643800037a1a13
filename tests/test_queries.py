import pytest
from oracle import connect, same

from cadenza.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    same(QUERIES[name](spark, small), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_repeats(spark, small, name):
    key = lambda rs: sorted(map(str, rs))
    first = QUERIES[name](spark, small).collect()
    assert first
    assert key(first) == key(QUERIES[name](spark, small).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["u", "c0", "c1", "cm", "g"]
    assert set(e.oracle_sql()) <= set(e.queries())
