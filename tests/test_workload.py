"""Every query against its SQL on the smallest tables; the rest must run and keep its rows."""

import pytest

from lautwerk import workload
from tests.compare import differences

SQL = workload.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    assert differences(spark, name, workload.queries()[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(workload.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert workload.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
