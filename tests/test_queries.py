import pytest

from sondage.queries import ORACLE, QUERIES
from tests.compare import check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
