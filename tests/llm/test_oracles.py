import pytest

from sondage.llm.queries import ORACLE, QUERIES
from tests.compare import check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir)
