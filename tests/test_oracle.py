"""Every registered query with a SQL twin gives the twin's rows."""

import oracle
import pytest

from tidesignal import plans, registry  # noqa: F401


@pytest.fixture(scope="module")
def duck(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, name):
    oracle.assert_same(registry.queries()[name](spark, small).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
