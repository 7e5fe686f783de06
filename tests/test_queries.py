import pytest

from pagewright.plans import queries as q
from tests.conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    same_as_sql(spark, q.queries()[name], q.oracle_sql()[name])


def test_queries_without_sql_have_rows(spark):
    for name in set(q.queries()) - set(q.oracle_sql()) - {"rendered_pages"}:
        assert q.queries()[name](spark, DATA).count(), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
