import pytest
from oracle import SF, compare

from __spark_entry__ import plans  # noqa: E402  (all modules of queries)

ORACLE, QUERIES = plans.ORACLE, plans.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
