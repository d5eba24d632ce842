"""Every registered log and graph query with SQL, against DuckDB on the smallest tables."""

import pytest

from conftest import SF, same
from faultline.plans.oracle import ORACLE
from faultline.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.execute(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
