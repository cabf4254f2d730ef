import pytest

from feedloop.llm import catalog
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SF), duck.execute(catalog.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
